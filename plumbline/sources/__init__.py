"""Input tables: repository files, expected paths and audit requests."""
