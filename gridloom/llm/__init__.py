"""Operators for large text corpora; nothing else in gridloom imports this subpackage."""
