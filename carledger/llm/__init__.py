"""Operators for preparing training data: language, duplicates, quality,
personal data, archives, mixing and packing. Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it."""
