"""Operators that prepare training text: ten methods, each usable on its own.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
