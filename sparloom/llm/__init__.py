"""Operators of a training-data pipeline: mixing, sketches, resharding, near
duplicates, language-model scores, WARC, byte-level BPE, quality rules,
repeated passages, personal data, prefix tries, manifests and packing.  Nothing outside this package imports it.
"""
