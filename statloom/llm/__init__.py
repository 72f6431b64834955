"""Operators for preparing language-model training data, all as Spark jobs.

Each module holds one operator with a general interface; ``queries`` registers
them over the tables ``documents``, ``pages``, ``embeddings`` and ``benchmark``.
Nothing outside this subpackage imports it.
"""
