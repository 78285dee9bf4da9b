"""Operators that prepare a text corpus for model training, and their registered queries."""
