"""Training-data operators: quality, deduplication, decontamination, privacy, tokens and scoring.

Nothing else in the library imports this subpackage.
"""
