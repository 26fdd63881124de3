"""Training-data operators: language, quality, duplicates, toxicity, tokens, chat logs and packing.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
