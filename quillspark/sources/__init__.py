"""Table readers, writers and parsers of stored files."""
