"""Column expressions (JVM side) and NumPy kernels with the same results."""
