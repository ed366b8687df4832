"""Operators over documents and their arrays of spans."""
