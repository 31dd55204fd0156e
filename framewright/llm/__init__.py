"""Training-data operators: archives, token files, near-duplicates, media, scoring, packing.

Nothing else in the library imports this subpackage.
"""
