"""Operators on large text collections: packing, leaked test passages, abusive language."""
