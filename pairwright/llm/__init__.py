"""Training-data operators: cleaning, matching, scoring, encoding and storing of text corpora.

Nothing else in the library imports this subpackage.
"""
