"""Reading flow files: discovery, mapping, canonical rows, profile."""
