"""Sorted streams of conversation rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that are worked on at once; a longer conversation is a chunk of its own.
CHUNK_ROWS = 1 << 16


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a role and a text, 32 bytes; the role's length keeps the two apart."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def changes(column: pa.Array) -> np.ndarray:
    """Where a value of a column differs from the one before; the first always does. Nulls equal each other."""
    at = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([np.ones(min(1, len(at)), bool), at[1:] != at[:-1]])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by the key, cut anew so that no group of the key is divided."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= CHUNK_ROWS:
            first = pa.concat_arrays([held[-1].column(key).slice(held[-1].num_rows - 1), batch.column(key)])
            begins = np.flatnonzero(changes(first)[1:])
            if len(begins):
                yield pa.Table.from_batches([*held, batch.slice(0, begins[0])]).combine_chunks()
                held, rows, batch = [], 0, batch.slice(begins[0])
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def crc32_sql(text: str) -> str:
    """The unsigned CRC of a text of ASCII characters, in DuckDB's SQL."""
    step = "list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), lambda acc, x: {step}))"
