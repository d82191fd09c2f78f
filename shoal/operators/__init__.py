"""Operators over DataFrames of photos, faces, people, vectors, hashes and pairs."""
