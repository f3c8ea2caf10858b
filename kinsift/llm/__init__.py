"""Operators that prepare and clean text and record collections for language-model training.

Nothing outside this subpackage imports it.
"""
