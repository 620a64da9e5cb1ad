"""Training-data operators: tokenising, privacy, extraction, filtering, sharding and duplicate removal.

Nothing else in the library imports this subpackage.
"""
