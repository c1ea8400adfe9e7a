"""The queries and DuckDB twins of this package, by name."""

from __future__ import annotations

from leafmill.llm import bpe, lattice, lines, lm, packing, pii, quality, simhash, urls, warc

MODULES = [quality, urls, bpe, lines, warc, lm, simhash, pii, packing, lattice]


def _each(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(m, name)
    return out


def queries() -> dict:
    return _each("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _each("ORACLES")
