"""Operators that prepare text and media corpora for language-model training.

Nothing else in the library imports this subpackage; ``queries`` registers what
it offers.
"""
