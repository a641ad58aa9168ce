"""Relational operators of the document index: every one takes and returns DataFrames."""
