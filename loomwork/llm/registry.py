"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import compression_quality, decontaminate, jaccard, line_chunks, merkle, mixing, oph, paragraphs, periodic, secrets, simhash, warc, wavelet

MODULES = [warc, paragraphs, oph, decontaminate, mixing, line_chunks, wavelet, compression_quality, secrets, simhash, merkle, periodic, jaccard]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
