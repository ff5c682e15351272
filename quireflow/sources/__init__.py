"""sources of quireflow."""
