"""Readers: files, JDBC databases, SQLite files; and the batch export."""
