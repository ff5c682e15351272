"""streaming of quireflow."""
