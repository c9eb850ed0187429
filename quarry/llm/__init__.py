"""Training-data operators: mixing, PII, sharding, language ID, line dedup, chat
windows, decontamination, HTML extraction and near-duplicate detection.

Nothing outside this package (but the guard in ``__spark_entry__.py``) imports it.
"""
