"""Operators for preparing training text at large scale.

Nothing else in the library imports this subpackage; see ``queries.py`` for
the registered queries and ``corpus_pipeline.py`` for the pipeline.
"""
