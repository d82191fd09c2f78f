"""Schemas, readers and writers, and the binding of the test tables to the data model."""
