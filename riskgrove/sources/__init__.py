"""Table readers, schemas and sinks."""
