"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from synthcal.sources.scratch import discard, fresh, written

fresh_path, materialize = fresh, written
__all__ = ["WORD", "discard", "fold", "fresh_path", "materialize", "stretches", "utf8"]

#: Fixed by the contracts: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def stretches(raw: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end at white space, so that no word is cut."""
    if len(raw) <= size:
        yield raw
        return
    first = 0
    while first < len(raw):
        end = first + size
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        yield raw[first:end]
        first = end
