"""Training-data operators: encoding, de-duplication, classification, search and packing.

Nothing else in the library imports this subpackage.
"""
