"""Training-data operators: language ID, tokenising, chat formatting, decontamination, archives and deduplication.

Nothing else in the library imports this subpackage.
"""
