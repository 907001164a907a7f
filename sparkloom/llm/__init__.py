"""Operators of a training-data pipeline: chunked media, licences, token files, secrets, packing,
near-duplicates, quality, SentencePiece and personal data.

Nothing else in the library imports this subpackage.
"""
