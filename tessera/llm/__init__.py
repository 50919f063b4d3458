"""Training-data operators: scoring, classification, deduplication, tokenising.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
