"""Training-data operators on Spark: fingerprints, deduplication, tokens, packing.

Nothing outside this package imports it; ``queries`` registers its queries.
"""
