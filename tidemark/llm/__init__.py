"""Operators for preparing large text corpora; see README.md for one paragraph about each."""
