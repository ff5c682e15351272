"""plans of quireflow."""
