"""Corpus operators for language-model training data.

Each module holds one operator with a general interface; ``queries.py`` holds
the thin ``opN_<name>`` queries that apply them to whole tables.
"""
