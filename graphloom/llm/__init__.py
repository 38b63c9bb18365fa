"""Training-data operators (text extraction, filtering, dedup, tokenising, archiving).

Nothing else in the library imports this subpackage.
"""
