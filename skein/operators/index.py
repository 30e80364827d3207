"""Stored indexes for search: postings with block maxima for words, an inverted file for vectors.

Both are Parquet tables under a folder that all executors share. Building and asking are apart, so a query reads its words'
blocks or its vector's cells and skips the rest.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.search import B, K1


def _postings(size: int, size_bytes: int):
    """Words of lower-cased texts, a block of rows at a time: a row for each word with the places and counts of its documents in the
    block, and a row without a word with the ids and lengths of all its documents. A block is known by its first row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        in_words = np.zeros(256, bool)
        in_words[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
        for batch in batches:
            long = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
            of_block = np.stack([np.arange(batch.num_rows) // size, long // size_bytes])
            cuts = np.flatnonzero(np.diff(of_block, prepend=-1).any(axis=0)).tolist()
            for start, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                rows = batch.slice(start, end - start)
                texts = rows.column("text").cast(pa.binary()).to_pylist()
                data = np.frombuffer(b" ".join(texts), np.uint8)
                inside = in_words[data]
                edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
                begin, length = edges[::2], edges[1::2] - edges[::2]
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                words = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
                place = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), begin, side="right") - 1
                lengths = np.bincount(place, minlength=len(texts))
                key, count = np.unique(words.indices.to_numpy().astype(np.int64) * len(texts) + place, return_counts=True)
                word, place = np.divmod(key, len(texts))
                first = np.flatnonzero(np.diff(word, prepend=-1))
                some = [0, *(len(texts) + first), len(texts) + len(word)]

                def of_rows(documents, reduce, values, first=first):
                    return np.concatenate([[documents], reduce.reduceat(values, first) if len(first) else []]).astype(np.int32)

                def lists(values, at=some):
                    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

                yield pa.RecordBatch.from_pydict({
                    "term": pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary]),
                    "block": pa.array(np.full(len(first) + 1, rows.column("row")[0].as_py())),
                    "docs": np.diff(some).astype(np.int32),
                    "tf": of_rows(0, np.maximum, count),
                    "n": of_rows(0, np.minimum, lengths[place]),
                    "words": np.concatenate([[len(words)], np.diff(np.concatenate([[0], np.cumsum(count)])[[*first, len(count)]])]).astype(np.int64),
                    "places": lists(pa.array(np.concatenate([np.arange(len(texts)), place]).astype(np.int32))),
                    "counts": lists(pa.array(np.concatenate([lengths, count]).astype(np.int32))),
                    "ids": lists(rows.column("id"), [0] + [len(texts)] * (len(first) + 1)),
                })

    return run


class KeywordIndex:
    """Okapi BM25 over postings, in segments.

    ``add`` writes a segment and touches no other. A segment's documents lie in blocks of ``1 << BLOCK_BITS`` rows, fewer where texts are
    long; a row of the table holds a word's documents of one block, their number, the largest count and the least length. A query
    reads that table for its words only. What a block's documents can score at most follows from it for any mean length, so after the
    most promising blocks have given a ``limit``-th score, lists of blocks that stay below it are never read. A file's rows are sorted
    by word and block, so row groups are skipped by their statistics.
    """

    BLOCK_BITS, FIRST_BLOCKS, BLOCK_BYTES = 12, 8, 1 << 24

    def __init__(self, spark: SparkSession, root: str, id_col: str = "doc_id", k1: float = K1, b: float = B):
        self.spark, self.root, self.id_col, self.k1, self.b = spark, root.rstrip("/"), id_col, k1, b

    def add(self, docs: DataFrame, text_col: str = "text") -> KeywordIndex:
        """A new segment of documents that the index does not hold yet. Documents without words count for the mean length."""
        self._rows(docs, text_col).write.option("parquet.block.size", 1 << 22).parquet(f"{self.root}/postings/segment={uuid.uuid4().hex}")
        return self

    def _rows(self, docs: DataFrame, text_col: str) -> DataFrame:
        """A segment's rows. The task that reads documents counts their words, sorts the rows and writes them: no word's rows of two tasks
        become one, so a shuffle would join nothing."""
        rows = docs.select(F.col(self.id_col).alias("id"), F.coalesce(F.lower(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
        columns = "term string, block long, docs int, tf int, n int, words long, places array<int>, counts array<int>, ids array<{}>"
        made = rows.mapInArrow(_postings(1 << self.BLOCK_BITS, self.BLOCK_BYTES), columns.format(docs.schema[self.id_col].dataType.simpleString()))
        return made.sortWithinPartitions("term", "block")

    def _part(self, tf: Column, n: Column, docs: int, df: int, mean: float) -> Column:
        idf = F.log(1 + (F.lit(float(docs)) - df + 0.5) / (df + 0.5))
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * n / F.lit(mean)))

    def search(self, query: str, limit: int) -> DataFrame:
        """(id, score) of the ``limit`` best documents that hold a query word, ties by id. A query without words finds nothing."""
        terms = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
        postings = self.spark.read.parquet(f"{self.root}/postings")
        postings = postings.where(F.isnull("term") | F.col("term").isin(*terms)) if terms else postings
        totals = postings.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).collect() if terms else []  # a row for each query word, one for all documents
        df = {r["term"]: r["docs"] for r in totals if r["term"] is not None}
        if not df:
            return postings.select(F.explode("ids").alias(self.id_col), F.lit(0.0).alias("score")).limit(0)
        docs, words = next((r["docs"], r["words"]) for r in totals if r["term"] is None)
        mean, terms = words / docs, sorted(df)
        most = [F.coalesce(self._part(F.max(F.when(F.col("term") == t, F.col("tf"))), F.min(F.when(F.col("term") == t, F.col("n"))), docs, df[t], mean), F.lit(0.0)) for t in terms]
        bounds = postings.where(F.col("term").isin(*terms)).groupBy("segment", "block").agg(reduce(lambda x, y: x + y, most).alias("most"))

        def scored(some: DataFrame) -> DataFrame:
            """Lists of a block meet before they become rows, and those need no shuffle."""
            held = postings.join(some.select("segment", "block"), ["segment", "block"], "left_semi").repartition("segment", "block")
            held = held.select("segment", "block", "term", F.inline(F.arrays_zip("places", "counts", "ids")))
            own = F.isnull("term")
            by_doc = held.groupBy("segment", "block", "places").agg(
                F.max(F.when(own, F.col("ids"))).alias(self.id_col), F.max(F.when(own, F.col("counts"))).alias("n"),
                *(F.max(F.when(F.col("term") == t, F.col("counts"))).alias(f"t{i}") for i, t in enumerate(terms)))
            parts = [self._part(F.coalesce(f"t{i}", F.lit(0)), F.col("n"), docs, df[t], mean) for i, t in enumerate(terms)]
            found = by_doc.where(F.coalesce(*(f"t{i}" for i in range(len(terms)))).isNotNull())
            return found.select(self.id_col, reduce(lambda x, y: x + y, parts).alias("score")).orderBy(F.desc("score"), self.id_col).limit(limit)

        promising = bounds.orderBy(F.desc("most"), "segment", "block").limit(self.FIRST_BLOCKS)
        least = scored(promising).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
        return scored(bounds if least["n"] < limit else bounds.where(F.col("most") * (1 + 1e-9) >= least["score"]))


def _matrix_of(column, width: int):
    """Vectors as rows of a matrix; null ones and vectors of another length as zeros."""
    import numpy as np
    import pyarrow.compute as pc

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    right = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    out = np.zeros((len(column), width))
    at = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    if len(at):
        out[at] = np.nan_to_num(column.filter(right).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(at), width)
    return out


def _near_cells(centroids, count: int, column: str = "vector"):
    """Adds to each row the cells of the centroids nearest to its vector, ties by cell."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        centres = np.array(centroids.value)
        for batch in batches:
            cells = [[] for _ in range(batch.num_rows)]
            if len(centres):
                far = -_matrix_of(batch.column(column), centres.shape[1]) @ centres.T
                cells = (far.argmin(axis=1)[:, None] if count == 1 else far.argsort(axis=1, kind="stable")[:, :count]).astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return run


def _best(limit: int, id_col: str):
    """Of a group of rows the best of each query of a group, among those of its cells where it has some; rows without a score come last."""

    def run(rows, queries):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = [("query_id", queries.schema.field("query_id").type), (id_col, rows.schema.field("id").type), ("cell", pa.int32()), ("certainty", pa.float64())]
        rows = rows.take(pc.sort_indices(rows, [("cell", "ascending"), ("id", "ascending")]))
        widths = [w for w in pc.list_value_length(rows["held"]).to_pylist() if w]
        width = max(widths, default=1)
        held, cell = _matrix_of(rows["held"], width), rows["cell"].to_numpy()
        place = np.argsort(pc.sort_indices(rows["id"]).to_numpy()) if rows.num_rows else np.zeros(0, int)
        size = np.sqrt((held * held).sum(axis=1))
        first = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1)) if rows.num_rows else np.zeros(0, int)
        runs = list(zip(first, [*first[1:], rows.num_rows], strict=True))
        out = [[], [], []]
        for start in range(0, queries.num_rows, 256):
            some = queries.slice(start, 256)
            asked, cells = _matrix_of(some["vector"], width), some["cells"].to_pylist()
            long = np.sqrt((asked * asked).sum(axis=1))
            score = np.full((len(asked), len(held)), -np.inf)  # not met
            if all(c is None for c in cells):
                score[:] = asked @ held.T
            else:
                wanted = [set(c) for c in cells]
                for a, b in runs:
                    mine = [q for q, w in enumerate(wanted) if cell[a] < 0 or cell[a] in w]
                    score[mine, a:b] = asked[mine] @ held[a:b].T
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(np.isneginf(score), score, score / (long[:, None] * size[None, :]))
            score[np.isnan(score)] = -9  # a null or zero vector
            for q, row in enumerate(score):
                least = np.partition(row, len(row) - limit)[len(row) - limit] if limit < len(row) else -np.inf
                at = np.flatnonzero((row >= least) & (row > -np.inf))
                at = at[np.lexsort((place[at], -row[at]))][:limit]
                out[0].append(np.full(len(at), start + q))
                out[1].append(at)
                out[2].append(row[at])
        q, at, value = (np.concatenate(x) if x else np.zeros(0) for x in out)
        certainty = pa.array((1 + value) / 2, pa.float64(), mask=value == -9)
        return pa.table([queries["query_id"].take(pa.array(q.astype(np.int64))), rows["id"].take(pa.array(at.astype(np.int64))), rows["cell"].take(pa.array(at.astype(np.int64))), certainty], schema=pa.schema(kinds))

    return run


class VectorIndex:
    """An inverted file: vectors in the cells of centroids found by k-means, asked by the cells nearest to a query.

    Vectors are normalised for the centroids, so cells follow the cosine; scores are exact cosines of what is in the probed cells. How many
    cells a query probes is found when the index is built: so many that of the exact neighbours of a sample of ``ASKED`` rows
    the share ``TARGET`` lies in probed cells. ``recall`` measures it for other queries. Rows with a null or zero vector are in
    a cell of their own that every query probes.
    """

    ASKED, NEIGHBOURS, TARGET = 200, 10, 0.97
    ROWS_AT_ONCE, QUERIES_AT_ONCE = 65_536, 8_192

    def __init__(self, spark: SparkSession, root: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.root, self.id_col, self.vector_col = spark, root.rstrip("/"), id_col, vector_col

    def build(self, units: DataFrame, cells: int | None = None, seed: int = 7, iterations: int = 10, sample: int = 200_000) -> VectorIndex:
        """Centroids come from at most about ``sample`` rows, chosen by a hash of the id; every row is then put into its cell. Without
        ``cells`` there are the square root of the rows."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        length = F.sqrt(F.aggregate(self.vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        unit = F.transform(self.vector_col, lambda x: x.cast("double") / F.col("length"))
        rows = units.withColumn("length", length)
        n = units.count()
        cells = cells or max(1, round(n**0.5))
        chosen = rows.where("length > 0").withColumn("unit", unit)
        if n > sample:
            chosen = chosen.where(F.pmod(F.xxhash64(self.id_col), F.lit(1_000_000)) < sample * 1_000_000 // n)
        chosen = chosen.repartition(2 * self.spark.sparkContext.defaultParallelism, self.id_col)  # the table may be one split
        points = chosen.select(array_to_vector("unit").alias("features"))
        if points.isEmpty():
            centroids = self.spark.createDataFrame([], "cell int, centroid array<double>")
        else:
            model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(points)
            centroids = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centroid array<double>")
        centroids.coalesce(1).write.parquet(f"{self.root}/centroids")
        self._place(rows).repartition("cell").sortWithinPartitions("cell").write.option("parquet.block.size", 1 << 22).parquet(f"{self.root}/vectors")
        asked = self.rows().where("cell >= 0").orderBy(F.xxhash64(self.id_col), self.id_col).limit(self.ASKED).select(F.col(self.id_col).alias("query_id"), F.col(self.vector_col).alias("vector"))
        cells = self._routed(asked, 1 << 30).select("query_id", F.posexplode("cells").alias("rank", "cell"))
        ranks = self.search_many(asked, self.NEIGHBOURS, exact=True).join(cells, ["query_id", "cell"]).groupBy("rank").agg(F.count(F.lit(1)).alias("n")).orderBy("rank").collect()  # a row for each cell
        left = self.TARGET * sum(r["n"] for r in ranks)
        probes = 1
        for r in ranks:
            if left > 0:
                probes, left = r["rank"] + 1, left - r["n"]
        self.spark.range(1).select(F.lit(probes).alias("probes")).write.parquet(f"{self.root}/probes")
        return self

    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.root}/probes").first()["probes"]

    def _routed(self, queries: DataFrame, probes: int) -> DataFrame:
        """The cells of the nearest centroids of each query."""
        return queries.select("query_id", "vector").mapInArrow(_near_cells(self._matrix(), probes), queries.select("query_id", "vector", F.array().cast("array<int>").alias("cells")).schema)

    def _centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/centroids")

    def _matrix(self):
        """All centroids in the order of their cells, for the tasks: the square root of the rows."""
        held = self._centroids().orderBy("cell").toArrow()["centroid"].to_pylist()
        return self.spark.sparkContext.broadcast(held)

    def _place(self, rows: DataFrame) -> DataFrame:
        asked = rows.withColumn("cells", F.array().cast("array<int>"))
        placed = rows.mapInArrow(_near_cells(self._matrix(), 1, self.vector_col), asked.schema)
        empty = F.col("length").isNull() | ~(F.col("length") > 0)
        return placed.withColumn("cell", F.when(empty, -1).otherwise(F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit(-1)))).drop("length", "cells")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")

    def search(self, query: list[float], limit: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """The nearest rows by cosine, as ``search.vector_search`` gives them, from the probed cells or by a scan of all."""
        from skein.operators.search import vector_search

        held = self.rows()
        if not exact:
            size = sum(x * x for x in query) ** 0.5 or 1.0
            asked = self.spark.createDataFrame([(0, [float(x) / size for x in query])], "query_id int, vector array<double>")
            held = held.where(F.col("cell").isin(-1, *self._routed(asked, probes or self.probes()).first()["cells"]))
        return vector_search(held.drop("cell"), query, limit, min_certainty=None, id_col=self.id_col, vector_col=self.vector_col)

    def search_many(self, queries: DataFrame, limit: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """queries: (query_id, vector). Rows (query_id, id, certainty, place): each query meets the rows of its cells by an equi-join.

        Rows and queries are dealt into groups of a bounded size, and each group of rows meets each group of queries in one task, as a product of
        matrices that leaves each query's best rows; so all pairs are scored in bounded memory.
        """
        queries, held = queries.select("query_id", "vector"), self.rows()
        asked = queries.withColumn("cells", F.lit(None).cast("array<int>")) if exact else self._routed(queries, probes or self.probes())
        n, least = held.count(), 2 * self.spark.sparkContext.defaultParallelism
        parts = max(1, -(-n // self.ROWS_AT_ONCE), min(least, n // 1024))
        blocks = max(1, -(-queries.count() // self.QUERIES_AT_ONCE))
        group = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
        every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        a = held.select(group(self.id_col, parts).alias("part"), F.col(self.id_col).alias("id"), F.col(self.vector_col).alias("held"), "cell").withColumn("block", every(blocks))
        b = asked.withColumn("block", group("query_id", blocks)).withColumn("part", every(parts))
        a, b = (x.repartition(parts * blocks, "part", "block").groupBy("part", "block") for x in (a, b))
        kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (held, self.id_col))}
        best = a.cogroup(b).applyInArrow(_best(limit, self.id_col), f"query_id {kinds['query_id']}, {self.id_col} {kinds[self.id_col]}, cell int, certainty double")
        order = Window.partitionBy("query_id").orderBy(F.desc("certainty"), self.id_col)
        return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)

    def recall(self, queries: DataFrame, limit: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, wanted, found): how many of the exact nearest rows the probes give."""
        want, got = (self.search_many(queries, limit, probes, exact).select("query_id", self.id_col) for exact in (True, False))
        both = want.join(got.withColumn("hit", F.lit(1)), ["query_id", self.id_col], "left")
        return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
