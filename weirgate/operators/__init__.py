"""DataFrame operators: document search, vector collections, graph patterns, document tables."""
