"""Operators for preparing large text corpora; self-contained, imported by nothing else in the library."""
