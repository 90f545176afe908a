"""Training-data operators: archives, search, near duplicates, filters, token stores.

Nothing else in the library imports this subpackage.
"""
