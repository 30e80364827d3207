"""Splitting symbols into chunks, and an encoder that needs no model."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOKENS, OVERLAP_TOKENS, DIMENSIONS = 512, 50, 384


class Chunker:
    """Lines one by one to chunks (content, first line, last line) of at most max_tokens * 4 characters, newlines not counted.

    A chunk repeats the last whole lines of the one before, up to overlap_tokens * 4 characters; a longer line is a chunk
    by itself. No more than a chunk's lines are held.
    """

    def __init__(self, start_line: int, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS):
        self.most, self.shared = max_tokens * 4, overlap_tokens * 4
        self.held, self.size, self.first, self.number = [], 0, start_line, start_line

    def add(self, line: str) -> tuple[str, int, int] | None:
        out = None
        if self.held and self.size + len(line) > self.most:
            out = "\n".join(self.held), self.first, self.number - 1
            keep = 0
            while keep < len(self.held) and sum(map(len, self.held[len(self.held) - keep - 1 :])) <= self.shared:
                keep += 1
            self.held = self.held[len(self.held) - keep :]
            self.size, self.first = sum(map(len, self.held)), self.number - keep
        self.held.append(line)
        self.size += len(line)
        self.number += 1
        return out

    def rest(self, end_line: int) -> tuple[str, int, int] | None:
        """The last chunk, which ends at the symbol's end."""
        return ("\n".join(self.held), self.first, end_line) if self.held else None


def split_lines(body: str, start_line: int, end_line: int, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[tuple[str, int, int]]:
    """All chunks of a text."""
    chunker = Chunker(start_line, max_tokens, overlap_tokens)
    return [c for c in (*map(chunker.add, body.split("\n")), chunker.rest(end_line)) if c]


_CHUNK = "part int, content string, start_line long, end_line long"


@F.udtf(returnType=_CHUNK)
class ChunkText:
    """In SQL: ``FROM symbols s, LATERAL chunk_text(s.body, s.start_line, s.end_line, 512, 50)``."""

    def eval(self, body: str, start_line: int, end_line: int, max_tokens: int, overlap_tokens: int):
        for part, chunk in enumerate(split_lines(body, start_line, end_line, max_tokens, overlap_tokens) if body is not None else ()):
            yield part, *chunk


@F.udtf(returnType=f"symbol_id string, {_CHUNK}")
class ChunkLines:
    """In SQL: ``FROM chunk_lines(TABLE(lines) PARTITION BY symbol_id ORDER BY line_number)`` over (symbol_id, line_number, line).

    Spark brings a symbol's lines together in order; a chunk's lines are held, never a symbol's.
    """

    def __init__(self):
        self.chunker, self.symbol, self.part, self.last = None, None, 0, 0

    def eval(self, row):
        if self.chunker is None:
            self.chunker, self.symbol = Chunker(row["line_number"]), str(row["symbol_id"])
        self.last = row["line_number"]
        chunk = self.chunker.add(row["line"] or "")
        if chunk:
            yield self.symbol, self.part, *chunk
            self.part += 1

    def terminate(self):
        if self.chunker is not None:
            yield self.symbol, self.part, *self.chunker.rest(self.last)


def register(spark) -> None:
    """The table functions chunk_text and chunk_lines in the session's SQL."""
    spark.udtf.register("chunk_text", ChunkText)
    spark.udtf.register("chunk_lines", ChunkLines)


def extract_chunks(symbols: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """symbols: (symbol_id, body, start_line, end_line). Bodies without text have no chunk; short ones are one chunk."""
    spark = symbols.sparkSession
    register(spark)
    full = symbols.where(F.trim("body") != "").withColumn("tokens", F.floor(F.char_length("body") / 4))
    short = full.where(F.col("tokens") <= max_tokens).select("symbol_id", F.lit(0).alias("part"), F.col("body").alias("content"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))
    long = full.where(F.col("tokens") > max_tokens)
    text = "SELECT s.symbol_id, c.* FROM {long} s, LATERAL chunk_text(s.body, s.start_line, s.end_line, {most}, {shared}) c"
    return short.unionByName(spark.sql(text, long=long, most=max_tokens, shared=overlap_tokens))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """Unit vectors of hashed words: the same text always has the same vector, texts that share words are close."""

    def one(text: str | None) -> np.ndarray:
        v = np.zeros(DIMENSIONS, np.float32)
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            v[h % DIMENSIONS] += 1 if h >> 31 else -1
        return v / (np.linalg.norm(v) or 1)

    return texts.map(one)
