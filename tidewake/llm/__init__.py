"""Operators for preparing training corpora at scale (nothing else in the library imports this subpackage)."""
