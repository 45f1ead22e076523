"""Training-data operators: fingerprints, decontamination, deduplication, tokenisation, classifiers and filters.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
