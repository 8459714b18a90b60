"""Jobs over training text and embeddings. Nothing else in the library imports this subpackage."""
