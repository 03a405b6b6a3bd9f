"""Operators over the logical tables of ``quillgraph.schema``."""
