"""Tables and the binary formats; text sinks."""
