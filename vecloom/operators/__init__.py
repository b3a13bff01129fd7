"""Search, clustering, graph and matrix operators."""
