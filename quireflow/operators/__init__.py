"""operators of quireflow."""
