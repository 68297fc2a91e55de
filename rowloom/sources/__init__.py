"""Readers and writers."""

from .labels import read_embeddings, read_label_dict
from .tables import read_table, read_tables, write_rows

__all__ = ["read_embeddings", "read_label_dict", "read_table", "read_tables", "write_rows"]
