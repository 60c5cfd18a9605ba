"""Quire: corpora of paged documents as Spark tables, and the operators over them."""
