"""Training-data operators: dedup, decontamination, cleaning, scoring, packing.

Nothing else in the library imports this subpackage.
"""
