"""Training-data operators: dedup, extraction, quality, privacy and mixing.

Nothing outside this folder imports it, so it can be removed whole.
"""
