"""Operators for training-data pipelines: WARC, chat, fingerprints, extraction, quality, licences, BPE, joins, decontamination, PII."""
