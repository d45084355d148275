"""Training-data operators: near duplicates, extraction, search, packing, filtering, privacy, scoring, tokens.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` depends on it.
"""
