"""MinHash near-dedup: universal hash minima, banding, signature and set verification, alternating stars.

1. Each document's distinct word shingles are hashed to 64 bits and give ``BANDS * ROWS`` minima of universal hashes.
2. Documents with equal sets, told by a 128-bit BLAKE2 digest of their shingles' bytes, form a class; only its smallest id goes on.
3. Representatives that share a band's minima share a bucket. A bucket never emits all its pairs. First it pairs its
   smallest id with the others, and one within a component is finished. Of the documents in other buckets, shingles that
   at most ``RARE`` of them hold are rare. Pairs that share a rare shingle come from an index of those, of bounded lists;
   all other pairs can share no more than their shingles that aren't rare, and many documents prove by that bound that
   nothing left in their bucket can reach the threshold. The buckets that are still open fall into families, which share no document.
   Within a family, what is left outside of a bucket's largest component is a query set: a task indexes the sets of a block
   of queries of ``QUERY_BYTES``, streams documents of the family past it, counts shared shingles and emits links only. A text
   is sent once for each block of its own family, so once but where queries of one family exceed a block. So every pair of
   a bucket is compared, excluded by its bound or known to be connected.
4. A pair is rejected if its minima agree far too seldom, and is confirmed on the full shingle sets of both whole texts, whose
   words are compared byte by byte. Links of the search are confirmed in the same way.
5. Components of the links come from alternating large-star and small-star, with each result written to the shared store.

At 40 bands of 5 rows, a pair of similarity 0.8 shares no bucket with a chance of 1.2e-7, and passes the signature test
(65 % of 200 minima) but for about 1e-7. Rows meet what is known of their bucket in ``SALTS`` parts, so a bucket with a third of all
rows is no task of its own; adaptive execution splits pair joins.

Defined results: a text without words has an empty set, no link and its own id as component; a text of fewer words than a
shingle is one shingle; a null text is empty; rows with a null id come back with null component and kept; rows of one id count
once, and if their texts differ, the one with the smallest MD5 digest is judged; an empty table gives no row; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textbytes as tb
from skein.llm.storage import Scratch

BANDS, ROWS, RARE = 40, 5, 16
#: Bytes of text in a block of queries, and in a part of the documents that is streamed past it.
QUERY_BYTES, PART_BYTES = 4 << 20, 32 << 20
#: Parts of a bucket's or a family's rows where they meet what is known of it.
SALTS = 16
#: Entries of inverted lists that are read at once.
_ENTRIES = 1 << 20
#: Elements of a block of universal hashes: hashes times shingles.
_BLOCK = 1 << 17


def _family(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift hashes a * x + b modulo 2 ** 64, of which the top 32 bits are used."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**64, (count, 1), np.uint64) | np.uint64(1), rng.integers(0, 2**64, (count, 1), np.uint64)


class Shingled:
    """The shingles of each text of a run."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, seed: int = 0):
        self.low, self.size = tb.LOWER[data], size
        self.starts, self.ends, self.first = tb.words(self.low, offsets, tb.SPACED)
        self.spans = tb.Spans(self.low)
        self.hashes = self.spans.hash(self.starts, self.ends, seed)
        self.whole = tb.shingles(self.hashes, size)

    def _texts(self) -> Iterator[tuple[int, int]]:
        return zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)

    def _short(self, lo: int, hi: int) -> np.ndarray:
        """Fewer words than a shingle are one shingle."""
        return tb.shingles(self.hashes[lo:hi], hi - lo, seed=hi - lo) if hi > lo else np.zeros(0, np.uint64)

    def sets(self) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        return [np.unique(self.whole[lo : hi - self.size + 1]) if hi - lo >= self.size else self._short(lo, hi) for lo, hi in self._texts()]

    def digested(self) -> tuple[list[np.ndarray], list[bytes]]:
        """The sets, and a digest of each set's shingles as bytes in the order of the set."""
        length = self.ends - self.starts + 1
        at = np.concatenate([[0], np.cumsum(length)])
        spaced = self.low[np.minimum(np.repeat(self.starts - at[:-1], length) + np.arange(at[-1]), len(self.low) - 1)] if len(self.low) else self.low
        spaced[at[1:] - 1] = 32  # words with one space behind each
        sets, digests = [], []
        for lo, hi in self._texts():
            digest = blake2b(digest_size=16)
            if hi - lo >= self.size:
                own, where = np.unique(self.whole[lo : hi - self.size + 1], return_index=True)
                begin, end = at[lo + where], at[lo + where + self.size]
                for i in range(0, len(own), 1 << 14):
                    b, n = begin[i : i + (1 << 14)], (end - begin)[i : i + (1 << 14)]
                    upto = np.cumsum(n)
                    digest.update(spaced[np.repeat(b - (upto - n), n) + np.arange(upto[-1])])
            else:
                own = self._short(lo, hi)
                digest.update(spaced[at[lo] : at[hi]])
            sets.append(own)
            digests.append(digest.digest())
        return sets, digests

    def exact_sets(self) -> list[np.ndarray]:
        """Sets of numbers that are equal between texts of the run if and only if the shingles are, byte by byte."""
        if self._distinct():
            return self.sets()
        raw, number = self.low.tobytes(), {}
        words = [raw[s:e] for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        out = []
        for lo, hi in self._texts():
            grams = {tuple(words[i : i + self.size]) for i in range(lo, max(hi - self.size, lo) + 1)} if hi > lo else set()
            if hi - lo < self.size:
                grams = {tuple(words[lo:hi])} - {()}
            out.append(np.array(sorted(number.setdefault(g, len(number)) for g in grams), np.uint64))
        return out

    def _distinct(self) -> bool:
        """Whether equal hashes of words and of shingles are all equal words and shingles."""
        if not self.spans.same_bytes(self.hashes, self.starts, self.ends):
            return False
        order = np.argsort(self.whole, kind="stable")
        twin = np.flatnonzero(self.whole[order[1:]] == self.whole[order[:-1]])
        if any((self.hashes[order[twin] + k] != self.hashes[order[twin + 1] + k]).any() for k in range(self.size)):
            return False
        known: dict[int, bytes] = {}
        for lo, hi in self._texts():
            if lo < hi < lo + self.size:
                number, own = int(self._short(lo, hi)[0]), self.hashes[lo:hi].tobytes()
                if known.setdefault(number, own) != own:
                    return False
        return not known or not np.isin(np.array(list(known), np.uint64), self.whole).any()


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, _BLOCK // len(a))
    for i in range(0, len(x), step):
        block = a * x[None, i : i + step]
        block += b
        np.minimum(best, block.min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


SIGNED = "doc_id long, row string, n_shingles long, digest binary, minima array<int>"


def _sign(size: int, count: int) -> Callable:
    def run(batches):
        a, b = _family(count)
        for batch in batches:
            data, offsets = tb.batch_of(batch.column(2))
            for lo, hi in tb.runs(offsets):
                sets, digests = Shingled(*tb.part(data, offsets, lo, hi), size).digested()
                flat = np.concatenate([minima(s, a, b) if len(s) else np.zeros(0, np.int32) for s in sets])
                ends = np.cumsum([0, *(count * bool(len(s)) for s in sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                columns = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists
                yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "row", "n_shingles", "digest", "minima"])

    return run


def _confirm(size: int, percent: int) -> Callable:
    def run(batches):
        for batch in batches:
            left, right = tb.batch_of(batch.column(2)), tb.batch_of(batch.column(3))
            links = np.zeros(batch.num_rows, bool)
            for lo, hi in tb.runs(left[1] + right[1]):
                texts, at = [], []
                for i in range(lo, hi):
                    x = left[0][left[1][i] : left[1][i + 1]]
                    if not texts or not np.array_equal(texts[at[-1]], x):  # neighbours often share their pivot
                        at.append(len(texts))
                        texts.append(x)
                    else:
                        at.append(at[-1])
                    texts.append(right[0][right[1][i] : right[1][i + 1]])
                sets = Shingled(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]), size).exact_sets()
                others = [k for k in range(len(texts)) if k not in set(at)]
                for i, u, v in zip(range(lo, hi), at, others, strict=True):
                    both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                    links[i] = both > 0 and 100 * both >= percent * (len(sets[u]) + len(sets[v]) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(links))

    return run


class _Index:
    """Inverted lists over the sets of a block of queries."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.shingles, first = np.unique(flat[order], return_index=True)
        self.of, self.first = of[order], np.append(first, len(flat))

    def links(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """The numbers of the queries that a set is linked with."""
        at = np.searchsorted(self.shingles, shingles)
        at = at[self.shingles[np.minimum(at, len(self.shingles) - 1)] == shingles]
        n = self.first[at + 1] - self.first[at]
        both = np.zeros(len(self.sizes), np.int64)
        for lo, hi in tb.runs(np.concatenate([[0], np.cumsum(n)]), _ENTRIES):
            size = n[lo:hi]
            spot = np.repeat(self.first[at[lo:hi]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            both += np.bincount(self.of[spot], minlength=len(self.sizes))
        return np.flatnonzero((100 + percent) * both >= percent * (self.sizes + len(shingles)))


class _Joined:
    """Components that links of a task have joined; only links that join two are worth sending."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _search(size: int, percent: int, seed: int) -> Callable:
    """Rows sorted by family, block, part and side: queries (side 0) are indexed, documents (side 1) searched.

    Of the links found only those go on that join two components.
    """

    def run(batches):
        key, named, sets, index, joined = None, [], [], None, _Joined()
        for batch in batches:
            data, offsets = tb.batch_of(batch.column("text"))
            doc, component, side, *places = (batch.column(c).to_pylist() for c in ("doc_id", "component", "side", "family", "block", "part"))
            places, out = list(zip(*places, strict=True)), []
            for lo, hi in tb.runs(offsets):
                for i, own in enumerate(Shingled(*tb.part(data, offsets, lo, hi), size, seed).sets(), lo):
                    if places[i] != key:
                        key, named, sets, index = places[i], [], [], None
                    if side[i] == 0:
                        named.append((doc[i], component[i]))
                        sets.append(own)
                    elif sets:
                        index = index or _Index(sets)
                        for k in index.links(own, percent).tolist():
                            if joined.join(named[k][1], component[i]):
                                out.append((named[k][0], doc[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _tokens(size: int) -> Callable:
    def run(batches):
        for batch in batches:
            data, offsets = tb.batch_of(batch.column(1))
            for lo, hi in tb.runs(offsets):
                sets = Shingled(*tb.part(data, offsets, lo, hi), size).sets()
                at = pa.array(np.repeat(np.arange(lo, hi), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(sets).view(np.int64))], ["doc_id", "shingle"])

    return run


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes with an edge (u, v); the component is its smallest node.

    Large-star hangs each node's larger neighbours under its smallest one; small-star does so with the smaller ones. Both
    aggregate with a map-side combine and join on the node, until no edge changes.
    """
    now, seen = scratch.keep(_oriented(edges, "u", "v"), "edges"), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _oriented(both.where("v > u").join(least, "u"), "v", "m")
        moved = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = scratch.keep(_oriented(moved.select(F.explode(F.array("u", "v")).alias("x"), "m"), "x", "m"), "stars")
        scratch.drop(now)
        now = small
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state


def _oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges from the larger to the smaller node, without loops."""
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _agree(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


class _Links:
    """Confirms candidate pairs and keeps the components that the links form."""

    def __init__(self, scratch: Scratch, signed: DataFrame, texts: DataFrame, size: int, percent: int, count: int):
        self.scratch, self.signed, self.texts, self.size, self.percent, self.count = scratch, signed, texts, size, percent, count
        self.components: DataFrame | None = None

    def add(self, pairs: DataFrame) -> None:
        """Confirms pairs (u, v), which are distinct, and links them."""
        least = int(self.count * max(0, self.percent - 15) / 100)
        sides = [self.signed.select(F.col("doc_id").alias(x), F.col("minima").alias(f"minima_{x}")) for x in "uv"]
        pairs = pairs.join(sides[0], "u").join(sides[1], "v").where(_agree(F.col("minima_u"), F.col("minima_v")) >= least).select("u", "v")
        pairs = self.scratch.keep(pairs, "pairs")
        self.link(self.confirmed(pairs))
        self.scratch.drop(pairs)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        sides = [self.texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "uv"]
        ready = pairs.join(sides[1], "v").join(sides[0], "u").select("u", "v", "text_u", "text_v")
        return self.scratch.keep(ready.mapInArrow(_confirm(self.size, self.percent), "u long, v long"), "links")

    def link(self, links: DataFrame) -> None:
        if links.isEmpty():
            return
        # the earlier components are stars, so stars and new links together have the same components as all links
        joined = links if self.components is None else links.union(self.components.select(F.col("node").alias("u"), F.col("component").alias("v")))
        self.components = connected_components(self.scratch, joined)

    def labels(self, nodes: DataFrame) -> DataFrame:
        """nodes with the column component beside doc_id."""
        if self.components is None:
            return nodes.withColumn("component", F.col("doc_id"))
        return nodes.join(self.components.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _met(rows: DataFrame, known: DataFrame, *key: str, how: str = "inner") -> DataFrame:
    """rows with what is known of their key, if anything is; rows of one key meet it in SALTS parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return salted.join(known.withColumn("salt", every), [*key, "salt"], how).drop("salt")


def _open(scratch: Scratch, found: _Links, rows: DataFrame) -> DataFrame:
    """The rows of buckets with several components, with their component, their bucket's largest one and its first document."""
    labelled = scratch.keep(found.labels(rows), "labelled")
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("parts"), F.min("first").alias("first")).where("parts > 1")
    kept = scratch.keep(_met(labelled, split.drop("parts"), "bucket"), "open")
    scratch.drop(labelled)
    return kept


def _compare_rest(scratch: Scratch, found: _Links, rows: DataFrame, size: int, percent: int) -> None:
    """Compares what the first round has left, by rare shingles, bounds and a search within families."""
    some = rows.select("doc_id").distinct()
    tokens = scratch.keep(found.texts.join(some, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_tokens(size), "doc_id long, shingle long"), "tokens")
    held = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") <= RARE)
    rare = scratch.keep(tokens.join(held, "shingle"), "rare")
    sizes = tokens.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(rare.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rare")), "doc_id", "left")
    sizes = scratch.keep(sizes.select("doc_id", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("common")), "sizes")
    scratch.drop(tokens)

    def reaches(common: Column, n: Column, m: Column) -> Column:
        """Whether so many common shingles can be enough between sets of n and m."""
        return (100 + percent) * common >= percent * (n + m)

    sized = found.labels(sizes)
    lists = rare.where("docs > 1").join(sized, "doc_id").groupBy("shingle").agg(F.collect_list(F.struct("doc_id", "n", "component")).alias("u"))  # of RARE at most
    pairs = lists.select(F.explode("u").alias("u"), F.col("u").alias("all")).select("u", F.explode("all").alias("v"))
    pairs = pairs.where((F.col("u.doc_id") < F.col("v.doc_id")) & (F.col("u.component") != F.col("v.component")) & reaches(F.least("u.n", "v.n"), F.col("u.n"), F.col("v.n")))
    sized = rows.join(sizes, "doc_id")
    medoids = sized.groupBy("bucket").agg(F.min(F.struct((F.col("n") - F.col("common")).alias("rare"), "doc_id"))["doc_id"].alias("p"), F.min("n").alias("least"))
    medoids = scratch.keep(medoids, "medoids")
    stars = _met(rows, medoids, "bucket").where("doc_id != p").select(F.least("p", "doc_id").alias("u"), F.greatest("p", "doc_id").alias("v"))
    found.add(pairs.select(F.col("u.doc_id").alias("u"), F.col("v.doc_id").alias("v")).union(stars).distinct())

    rest = _met(sized, medoids, "bucket").where(reaches(F.col("common"), F.col("n"), F.col("least"))).select("bucket", "doc_id")
    left = _open(scratch, found, rest)
    scratch.drop(rare, sizes, medoids)
    if not left.isEmpty():
        _search_families(scratch, found, left, size, percent)
    scratch.drop(left)


def _search_families(scratch: Scratch, found: _Links, rows: DataFrame, size: int, percent: int) -> None:
    """Compares, within families of buckets, the documents outside of a bucket's largest component with all."""
    families = connected_components(scratch, rows.select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
    docs = rows.groupBy("doc_id").agg(F.max((F.col("component") != F.col("largest")).cast("int")).alias("query"), F.min("component").alias("component"))
    docs = docs.join(families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id", "left").withColumn("family", F.coalesce("family", "doc_id"))
    docs = scratch.keep(found.texts.join(docs, "doc_id").select("doc_id", "text", "family", "component", "query", F.octet_length("text").alias("bytes")), "family")

    def pieces(column: Column, most: int) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.sum(column) / F.lit(most))).cast("int")

    totals = docs.groupBy("family").agg(F.max("query").alias("any"), pieces(F.col("bytes") * F.col("query"), QUERY_BYTES).alias("blocks"), pieces(F.col("bytes"), PART_BYTES).alias("parts"))
    dealt = _met(docs.drop("bytes"), totals.where("any = 1").drop("any"), "family")

    def one(salt: int, n: str) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    queries = dealt.where("query = 1").withColumns({"block": one(1, "blocks"), "part": every("parts"), "side": F.lit(0)})
    against = dealt.withColumns({"block": every("blocks"), "part": one(2, "parts"), "side": F.lit(1)})
    met = queries.unionByName(against).drop("query", "blocks", "parts").repartition("family", "block", "part").sortWithinPartitions("family", "block", "part", "side", "doc_id")
    seed = 0
    while True:
        pairs = scratch.keep(met.mapInArrow(_search(size, percent, seed), "u long, v long").distinct(), "candidates")
        links = found.confirmed(pairs)
        if links.count() == pairs.count():
            break
        found.link(links)
        seed += 1  # two shingles shared a hash, so a pair that looked linked may have hidden another
    found.link(links)
    scratch.drop(docs, pairs)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per id: n_shingles, component_id (the smallest id reachable over links) and kept.

    A link holds between documents with 100 * |A & B| >= percent * |A | B|. Ids are integers.
    """
    spark, count = docs.sparkSession, bands * rows
    scratch = Scratch(spark, "minhash")
    all_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col).alias("text"))
    signed = scratch.keep(all_docs.mapInArrow(_sign(shingle_words, count), SIGNED), "signed")
    sets = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("row", "n_shingles", "digest")).alias("s")).select("doc_id", "s.*")
    full = sets.where("n_shingles > 0")
    classes = full.groupBy("digest", "n_shingles").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.count(F.lit(1)).alias("members")).select("digest", "n_shingles", "members", "rep.*")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("minima", i * rows + 1, rows)))).alias("bucket")
    entries = signed.join(classes.select("doc_id", "row"), ["doc_id", "row"], "left_semi").select("doc_id", "row", band)
    shared = entries.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot < last").select("bucket", "pivot")
    buckets = scratch.keep(entries.join(shared, "bucket").select("bucket", "doc_id", "row", "pivot"), "buckets")
    members = scratch.keep(buckets.select("doc_id", "row").distinct(), "members")
    texts = scratch.keep(all_docs.join(members, ["doc_id", "row"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]), "texts")
    minima_of = scratch.keep(signed.join(members, ["doc_id", "row"], "left_semi").select("doc_id", "minima").dropDuplicates(["doc_id"]), "minima")
    found = _Links(scratch, minima_of, texts, shingle_words, percent, count)

    found.add(buckets.where("doc_id != pivot").select(F.col("pivot").alias("u"), F.col("doc_id").alias("v")).distinct())
    open_rows = _open(scratch, found, buckets.where("doc_id != pivot").select("bucket", "doc_id"))
    scratch.drop(buckets, members)
    if not open_rows.isEmpty():
        _compare_rest(scratch, found, open_rows.select("bucket", "doc_id"), shingle_words, percent)
    scratch.drop(open_rows, texts, minima_of)

    shared_sets = classes.where("members > 1").select("digest", "n_shingles", F.col("doc_id").alias("rep"))
    rows_out = _met(full, shared_sets, "digest", "n_shingles", how="left").select(F.col("doc_id").alias("id"), "n_shingles", F.coalesce("rep", "doc_id").alias("doc_id"))
    linked = found.labels(rows_out).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    unnamed = signed.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    out = linked.union(alone).union(unnamed)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)
