"""functions of quireflow."""
