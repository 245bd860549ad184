"""Training-data operators: dedup, decontamination, toxicity, PII, sharding, packing, token counts.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
