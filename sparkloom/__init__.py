"""A PySpark engine for document collections: ingest, rank, fuse, select and pack text for tasks."""
