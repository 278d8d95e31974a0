"""Corpus preparation operators for large text collections.

One module per operator; ``queries.py`` registers the thin ``opN_<name>``
queries.  Nothing outside this subpackage imports it.
"""
