"""Conversation prefix trie: one node for each distinct sequence of first turns, with counts over its subtree.

Turns are told by the SHA-256 of role and text, so no text leaves its scan. Polynomial rolling fingerprints of all prefixes
(two 31-bit primes) come from cumulative sums in numpy over rows sorted by conversation; prefixes of one depth and
fingerprint are a candidate group, whose representative is its smallest member. Every member's turn and the fingerprint of
what is before it are then compared with the representative's; where all agree, prefixes agree turn by turn, since the same
holds one turn earlier. If any differs, all prefixes are fingerprinted again with another base and other bytes of the
digests, which splits the groups of a collision, until a round has none.

The rollup to parents needs no pass for each depth. The representative of a node also represents all nodes below it on its own way,
so each node counts once along the prefixes of its representative: sums from the deep end of each conversation, then sums over
the members of each node. Counting combines on the map side; the root, which all conversations share, is never a join key.
Lists of members that end at a node are joined as texts of up to ``LIST`` ids before they meet, and hashed as a stream.

A conversation's rows (some 60 bytes a turn) pass one task in order, a batch at a time.

Defined results: rows with a null id belong to no conversation; a null role or text is empty; rows of equal turn stand in the order
of their digests, so repeated rows are turns of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.storage import Scratch
from skein.llm.talk import changes, crc32_sql, turn_digest

PRIMES = (2**31 - 1, 2**31 - 19)
#: Bits of a fingerprint in the first round; later rounds always take all.
BITS = 62
#: Ids in a piece of a node's list.
LIST = 4096


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), by doubling."""
    out, p = np.ones(1, np.uint64), np.uint64(prime)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % p])
    return out[:n]


def rolling(values: np.ndarray, first: np.ndarray, carry: int, base: int, prime: int) -> np.ndarray:
    """Fingerprints after each value: f = f * base + value modulo the prime, from 0 at each ``first`` and from ``carry`` at the start.

    A scan: values times powers of the inverse base are summed up, and each sum is scaled back.
    """
    p, n = np.uint64(prime), len(values)
    begins = np.flatnonzero(first)
    start = np.zeros(n, np.int64)
    start[begins] = begins
    start = np.maximum.accumulate(start)
    place = np.arange(n) - start
    up, down = powers(base, prime, n + 1), powers(pow(base, -1, prime), prime, n)
    sums = np.cumsum(values.astype(np.uint64) % p * down[place] % p)
    before = np.concatenate([np.zeros(1, np.uint64), sums])[start]
    out = (sums - before) % p * up[place] % p
    lead = start == 0 if not (n and first[0]) else np.zeros(n, bool)
    out[lead] = (out[lead] + np.uint64(carry) * up[place[lead] + 1] % p) % p
    return out


def _fingerprints(turn_round: int, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = [int.from_bytes(hashlib.sha256(f"{turn_round}:{p}".encode()).digest()[:4], "little") % (p - 1000) + 500 for p in PRIMES]
        mask, carry, last = np.uint64((1 << bits) - 1), [0] * len(PRIMES), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id")
            edge = ids if last is None else pa.concat_arrays([last, ids])
            first = changes(edge)[0 if last is None else 1 :]
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
            word = np.ascontiguousarray(digest[:, 8 * (turn_round % 4) : 8 * (turn_round % 4) + 8]).view("<u8")[:, 0]
            parts = []
            for k, prime in enumerate(PRIMES):
                parts.append(rolling(word >> np.uint64(k * 16), first, carry[k], bases[k], prime))
            packed = (parts[0] << np.uint64(31) | parts[1]) & mask
            before = np.concatenate([[np.uint64(carry[0]) << np.uint64(31) | np.uint64(carry[1])], packed[:-1]]).astype(np.uint64) & mask
            before[first] = 0
            carry, last = [int(x[-1]) for x in parts], ids.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([ids, batch.column("depth"), pa.array(packed.astype(np.int64)), pa.array(before.astype(np.int64)), batch.column("digest"), batch.column("chars")], ["id", "depth", "print", "before", "digest", "chars"])

    return run


def turn_digests(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, place from 1, digest, chars): each conversation's turns in order, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), turn_digest(role, text).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    order = Window.partitionBy("id").orderBy("turn", "digest")  # ascending puts nulls first
    return rows.select("id", F.row_number().over(order).cast("long").alias("place"), "digest", "chars")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, print, id) to pieces (depth, print, first id, the ids joined by commas)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = changes(batch.column("depth")) | changes(batch.column("print"))
        begins = np.flatnonzero(new)
        cuts = np.unique(np.concatenate([np.arange(b, e, LIST) for b, e in zip(begins, [*begins[1:], len(new)])]))
        ids = batch.column("id").cast(pa.string()).to_pylist()
        pieces = [",".join(ids[b:e]) for b, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)])]
        at = pa.array(cuts)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("depth", "print", "id")), pa.array(pieces, pa.string())], ["depth", "print", "first", "piece"])


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest, kinds = None, None, (pa.int64(), pa.int64(), pa.string())
    names = ["depth", "print", "ends_sha256"]
    for batch in batches:
        done = []
        for depth, mark, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "print", "piece")), strict=True):
            if (depth, mark) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (depth, mark), hashlib.sha256(piece.encode())
            else:
                digest.update(f",{piece}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*key, digest.hexdigest()), kinds, strict=True)], names)


def _verified(scratch: Scratch, turns: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes (id, depth, print, before, chars) and their nodes, of the first round without a collision."""
    kind = turns.schema["id"].dataType.simpleString()
    stream = turns.select("id", F.col("place").alias("depth"), "digest", "chars").repartition("id").sortWithinPartitions("id", "depth")
    number = 0
    while True:
        found = stream.mapInArrow(_fingerprints(number, bits if number == 0 else 62), f"id {kind}, depth long, print long, before long, digest binary, chars long")
        prefixes = scratch.keep(found, "prefixes")
        nodes = scratch.keep(prefixes.groupBy("depth", "print").agg(F.min("id").alias("conv"), F.count(F.lit(1)).alias("n_convs")), "nodes")
        of = prefixes.select(F.col("id").alias("conv"), "depth", F.col("print").alias("p"), F.col("before").alias("b"), F.col("digest").alias("d"))
        chosen = nodes.where("n_convs > 1").join(of, ["conv", "depth"]).where("p = print").select("conv", "depth", "print", "b", "d")
        differ = prefixes.join(chosen, ["depth", "print"]).where("id <> conv AND (digest <> d OR before <> b)")
        if differ.isEmpty():
            return prefixes, nodes
        scratch.drop(prefixes, nodes)
        number += 1


def trie(turns: DataFrame, ids: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """turns: (id, place from 1, digest, chars); ids: all conversations (id, unique), where some have no turn.

    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    if ids is None:
        ids = turns.select("id").distinct()
    prefixes, nodes = _verified(scratch, turns, bits)
    kids = nodes_before(prefixes, nodes)
    own = prefixes.select(F.col("id").alias("conv"), "depth", "before", "chars")
    full = nodes.join(own, ["conv", "depth"]).join(kids, ["depth", "print"], "left")
    full = full.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    full = scratch.keep(full.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "full")
    # a node counts at its representative's row; running sums from the deep end give what is below each of its prefixes
    counted = prefixes.select("id", "depth", "print").join(full.select(F.col("conv").alias("id"), "depth", "leaf", "saved"), ["id", "depth"], "left")
    deep = Window.partitionBy("id").orderBy(F.desc("depth"))
    below = counted.select("depth", "print", *(F.sum(F.coalesce(c, F.lit(0))).over(deep).alias(c) for c in ("leaf", "saved")))
    sums = below.groupBy("depth", "print").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    last = prefixes.groupBy("id").agg(F.max(F.struct("depth", "print")).alias("last"))
    ends = ids.join(last, "id", "left").select(F.coalesce("last.depth", F.lit(0)).alias("depth"), F.coalesce("last.print", F.lit(0)).alias("print"), "id")
    kind = ends.schema["id"].dataType.simpleString()
    pieces = ends.repartitionByRange("depth", "print", "id").sortWithinPartitions("depth", "print", "id").mapInArrow(_lists, f"depth long, print long, first {kind}, piece string")
    lists = scratch.keep(pieces.repartition("depth", "print").sortWithinPartitions("depth", "print", "first").mapInArrow(_list_digests, "depth long, print long, ends_sha256 string"), "ends")
    top = ids.agg(F.min("id").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")  # one row
    below_top = full.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    top_list = lists.where("depth = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    root = top.join(F.broadcast(below_top)).join(F.broadcast(top_list))  # one row each
    root = root.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast(kind).alias("parent"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "ends_sha256")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("before"), F.col("conv").alias("parent"))
    met = full.where("depth > 1").join(above, ["depth", "before"])
    first = full.where("depth = 1").join(F.broadcast(top.select(F.col("conv").alias("parent"))))  # one row
    named = reduce(DataFrame.unionByName, (x.select("conv", "depth", "print", "parent", "n_convs", "n_children") for x in (met, first)))
    inner = named.join(sums, ["depth", "print"]).join(lists, ["depth", "print"], "left").drop("print")
    out = root.unionByName(inner).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes_before(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, print, n_children) of the nodes that have children."""
    of = prefixes.select(F.col("id").alias("conv"), "depth", "before")
    return nodes.join(of, ["conv", "depth"]).groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("print")).agg(F.count(F.lit(1)).alias("n_children"))


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """The trie of conversations given as rows of turns."""
    return trie(turn_digests(conversations, id_col, **columns))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation after the first turns of its hundred's first one, a number that the CRC of its id chooses in place of as many
    of its own: turns and ids."""
    ids = turns.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    chosen = ids.select("id", (F.col("id") - F.col("id") % 100).alias("base"), (F.crc32(F.col("id").cast("string")) % 6).alias("h"))
    sizes = ids.select(F.col("id").alias("base"), F.col("size").alias("there"))
    chosen = chosen.join(sizes, "base", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0))))
    lent = turns.where("id % 100 = 0 AND place <= 5").withColumnRenamed("id", "base")
    new = lent.join(chosen.where("given > 0"), "base").where("place <= given").select("id", "place", "digest", "chars")
    own = turns.join(chosen.select("id", "h", "given"), "id").where("place > h").select("id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "digest", "chars")
    return new.unionByName(own), ids.select("id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    kept = Scratch(spark, "turns").keep(turns, "turns")
    return trie(*rebuilt(kept))


#: The exact prefixes as lists of turns; a node counts along the prefixes of its smallest member.
ORACLE = f"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, count(*) AS size, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM c GROUP BY conv_id),
w AS (SELECT i.conv_id, i.h, i.conv_id - i.conv_id % 100 AS base, least(i.h, coalesce(b.size, 0)) AS given FROM ids i LEFT JOIN ids b ON b.conv_id = i.conv_id - i.conv_id % 100),
t AS (SELECT w.conv_id, c.place, c.role, c.text FROM w JOIN c ON c.conv_id = w.base AND c.place <= w.given
      UNION ALL SELECT w.conv_id, c.place - w.h + w.given, c.role, c.text FROM w JOIN c ON c.conv_id = w.conv_id AND c.place > w.h),
m AS (SELECT conv_id, place AS depth, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY place) AS prefix, length(text) AS chars FROM t
      UNION ALL SELECT conv_id, 0, [], 0 FROM ids),
e AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
n AS (SELECT m.depth, prefix, min(m.conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
      sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE last = m.depth), '')) AS ends_sha256 FROM m JOIN e ON e.conv_id = m.conv_id GROUP BY m.depth, prefix),
p AS (SELECT n.*, u.conv_id AS parent_conv_id FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n u ON u.depth = m.depth AND u.prefix = m.prefix),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM p LEFT JOIN k ON k.conv_id = p.conv_id AND k.depth = p.depth),
s AS (SELECT m.depth, m.prefix, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens FROM f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.depth = f.depth AND s.prefix = f.prefix
"""
