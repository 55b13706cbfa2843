"""Table readers, writers, declared schemas and the column binding of the driver tables."""
