"""Token ids of documents in sorted-string-table shards.

A shard is one immutable file:

    blocks   each a zstd frame of entries in ascending key order
    index    one zstd frame: for each block its first key (length, bytes), offset and length
    filter   Bloom filter bits over all keys
    footer   fixed size: offsets and lengths of index and filter, counts, magic number

A key is the identifier as eight big-endian bytes with the sign flipped, so byte order is number order. An entry is the
length of the prefix that its key shares with the key before (0 at a block's start), the rest of the key, the number of ids
and the ids, two bytes each where all fit and four otherwise. ``Shard.get`` asks the filter, searches the index by halves
and reads one block; ``Shards`` finds the shard by its range of identifiers.

Shards are ranges of identifiers and together one sorted table. Tasks write under names of their own and only files of
tasks that succeeded enter the manifest, so a retried or duplicated task leaves at worst an unlisted file.

Defined results: a null or empty text has the end id only; repeated ids keep an entry each, in the order of their texts'
digests, and ``get`` returns the first; a null id is the empty key, before all others; an empty table has no shard and no row;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import textbytes as tb
from skein.llm.storage import Scratch

MAGIC = b"SKSST01\n"
_FOOTER = struct.Struct("<QQQQQQ8s")
_HEAD = struct.Struct("<BBBI")
BLOCK_BYTES, BITS_PER_KEY, PROBES = 64 << 10, 10, 7
END_ID = 0
#: Distinct chunks of text whose ids an encoder keeps, and the bytes that such a chunk may have; less than 100 bytes of memory each.
CACHED, KEPT_BYTES = 1_000_000, 32
# fixed values: the tokenizer set-up for which the cuts below are proven
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Encoder:
    """Ids of texts as the tokenizers library gives them for the whole text, with its defaults; each distinct chunk goes through it once.

    With a byte-level BPE model a text is cut into chunks at places where the tokenizer's pattern

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    ends a piece whatever else the text holds, so that chunks encode on their own to the ids they have in the whole text:

    * before a space or line feed that follows a visible ASCII character or one from U+00C0 to U+07FF, none of which is white space. No
      alternative goes on from another character to white space, and the look-ahead, the only one, concerns what follows white
      space, which stays with it;
    * after a line feed between two visible ASCII characters, which is a piece by either of the last alternatives;
    * before a point or comma that follows an ASCII letter or digit, as no alternative has one of those and then one of these.

    A text that holds the string of a special or added token is encoded as a whole, and so are all texts if the file sets up anything
    else. Chunks are found and looked up as arrays by 64-bit hashes, and compared byte by byte with the chunk that has the hash; should two
    chunks differ, the texts are encoded as a whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        model, before = setup["model"], setup["pre_tokenizer"] or {}
        self.cuts = model["type"] == "BPE" and not model.get("dropout") and {k: before.get(k) for k in _BYTE_LEVEL} == _BYTE_LEVEL
        self.cuts = self.cuts and all(setup[k] is None for k in ("normalizer", "truncation", "padding"))
        self.special = [t["content"].encode() for t in setup["added_tokens"]]
        self.dtype = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose bytes begin with a space
        self.spaced[[i for x, i in vocabulary.items() if x[:1] == "\u0120"]] = True
        self.end = np.array([end_id], self.dtype)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0
        self.spans, self.begin, self.length = tb.Spans(np.zeros(0, np.uint8)), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list[str]) -> list[np.ndarray]:
        """Words with their space are one piece each, so many are encoded as one text and told apart by their spaces."""
        out: list[np.ndarray] = [self.end] * len(chunks)
        words = [i for i, x in enumerate(chunks) if x[:1] == " " and x[1:].isalpha()]
        others = sorted(set(range(len(chunks))).difference(words))
        for i, ids in zip(others, self._whole([chunks[i] for i in others]), strict=True):
            out[i] = ids
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        for group, ids in zip(groups, self._whole(["".join(chunks[i] for i in g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.spaced[ids]).tolist()
            same = len(cuts) == len(group)
            parts = [ids[a:b] for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)] if same else self._whole([chunks[i] for i in group])
            for i, part in zip(group, parts, strict=True):
                out[i] = part
        return out

    def _room(self, n: int) -> None:
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(n, len(self.ids)), self.dtype)])

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        """Adds chunks under their hashes, which are sorted and new."""
        found = self._encode([x.decode("utf-8", "replace") for x in chunks])
        size = np.array([len(x) for x in found], np.int32)
        at = self.used + np.cumsum(size) - size
        self._room(int(size.sum()))
        self.used += int(size.sum())
        self.ids[at[0] : self.used] = np.concatenate(found)
        length = np.array([len(x) for x in chunks], np.int64)
        begin = len(self.spans.padded) - 8 + np.cumsum(length) - length
        self.spans = tb.Spans(np.concatenate([self.spans.padded[:-8], np.frombuffer(b"".join(chunks), np.uint8)]))
        place = np.searchsorted(self.hashes, hashes)
        for name, new in (("hashes", hashes), ("at", at), ("size", size), ("begin", begin), ("length", length)):
            setattr(self, name, np.insert(getattr(self, name), place, new))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text with the end id; a null is an empty text."""
        data, offsets = tb.batch_of(texts)
        out: list[np.ndarray] = []
        for lo, hi in tb.runs(offsets):
            part = tb.part(data, offsets, lo, hi)
            found = self._run(*part) if self.cuts else None
            if found is None:
                raw = part[0].tobytes()
                found = self._whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(part[1][:-1].tolist(), part[1][1:].tolist(), strict=True)])
            out += [np.concatenate([x, self.end]) for x in found]
        return out

    def _starts(self, data: np.ndarray, offsets: np.ndarray, raw: bytes) -> np.ndarray:
        """Where chunks begin."""
        n = len(data)
        feed, low = data == 10, tb.LOWER[data]
        visible = (data > 32) & (data < 127)
        alnum = ((low >= 97) & (low < 123)) | ((data >= 48) & (data < 58))
        cut = np.zeros(n + 1, bool)
        letter = np.zeros(n, bool)  # a character from U+00C0 to U+07FF ends here
        letter[1:] = (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        cut[1:n] = ((visible | letter)[:-1] & (feed[1:] | (data[1:] == 32))) | (alnum[:-1] & ((data[1:] == 44) | (data[1:] == 46)))
        cut[2:n] |= visible[:-2] & feed[1:-1] & visible[2:]
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right"))
                cut[offsets[text - 1] : offsets[text]] = False
                at = raw.find(token, int(offsets[text]))
        cut[offsets] = True
        return np.flatnonzero(cut[:n])

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray] | None:
        """The ids of each text of a run, or None if two chunks share a hash."""
        raw = data.tobytes()
        starts = self._starts(data, offsets, raw)
        sizes = np.diff(np.append(starts, len(data)))
        short = sizes <= KEPT_BYTES
        spans, begin, length = tb.Spans(data), starts[short], sizes[short]
        unique, where, inverse = np.unique(spans.hash(begin, begin + length), return_index=True, return_inverse=True)
        head = where[inverse]
        if not ((length == length[head]).all() and spans.equal(begin, begin[head], length).all()):
            return None
        place = np.searchsorted(self.hashes, unique)
        known = np.append(self.hashes, 0)[place] == unique
        known &= place < len(self.hashes)
        if len(self.hashes) + (~known).sum() > CACHED:
            self._forget()
            known[:] = False
        if known.any():
            at, own = place[known], where[known]
            if not ((self.length[at] == length[own]).all() and spans.equal(begin[own], self.begin[at], length[own], self.spans).all()):
                return None
        if not known.all():
            new = where[~known]
            self._learn(unique[~known], [raw[s : s + n] for s, n in zip(begin[new].tolist(), length[new].tolist(), strict=True)])
        at, size = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        place = np.searchsorted(self.hashes, unique)[inverse]
        at[short], size[short] = self.at[place], self.size[place]
        if not short.all():  # long chunks stand behind the known ids until the next run
            found = self._whole([raw[s : s + n].decode("utf-8", "replace") for s, n in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True)])
            size[~short] = n = np.array([len(x) for x in found])
            at[~short] = self.used + np.cumsum(n) - n
            self._room(int(n.sum()))
            self.ids[self.used : self.used + n.sum()] = np.concatenate(found)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """This process's encoder, which keeps its chunks from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def key_of(identifier: int | None) -> bytes:
    return b"" if identifier is None else ((identifier + (1 << 63)) % (1 << 64)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _probe(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.adler32(key) * 0x9E3779B1 % 2**32 | 1


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = _probe(key)
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Takes entries in ascending key order; holds one block, the index and eight bytes for each key's filter bits in memory."""

    def __init__(self, sink, block_bytes: int = BLOCK_BYTES):
        self.sink, self.block_bytes = sink, block_bytes
        self.block, self.index, self.at, self.count, self.tokens = bytearray(), bytearray(), 0, 0, 0
        self.probes, self.codec, self.last, self.previous = array("I"), pa.Codec("zstd", 1), b"", b""

    def add(self, identifier: int | None, ids: np.ndarray) -> None:
        key = key_of(identifier)
        if key < self.previous:
            raise ValueError("keys must ascend")
        if not self.block:
            self.first, self.last = key, b""
        shared = len(os.path.commonprefix([key, self.last]))
        self.block += _HEAD.pack(shared, len(key) - shared, ids.dtype.itemsize, len(ids)) + key[shared:] + ids.tobytes()
        self.probes.extend(_probe(key))
        self.last = self.previous = key
        self.count, self.tokens = self.count + 1, self.tokens + len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = struct.pack("<Q", len(self.block)) + self.codec.compress(bytes(self.block), asbytes=True)
            self.index += struct.pack("<B", len(self.first)) + self.first + struct.pack("<QQ", self.at, len(packed))
            self.sink.write(packed)
            self.at, self.block = self.at + len(packed), bytearray()

    def close(self) -> None:
        self._flush()
        index = struct.pack("<Q", len(self.index)) + self.codec.compress(bytes(self.index), asbytes=True)
        bits = max(64, BITS_PER_KEY * self.count)
        table, (a, b) = np.zeros(bits, bool), np.array(self.probes, np.uint64).reshape(-1, 2).T
        for i in range(PROBES):
            table[(a + np.uint64(i) * b) % np.uint64(bits)] = True
        packed = struct.pack("<Q", bits) + np.packbits(table).tobytes()
        self.sink.write(index)
        self.sink.write(packed)
        self.sink.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.count, self.tokens, MAGIC))


def _unpack(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], struct.unpack("<Q", packed[:8])[0], asbytes=True)


class Shard:
    """A shard open for reading: the index and the filter in memory, blocks as they are asked for."""

    def __init__(self, path: str):
        system, name = pafs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        at, length, bloom_at, bloom_length, self.count, self.tokens, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        index, self.firsts, self.places = _unpack(self.file.read_at(length, at)) if self.count else b"", [], []
        i = 0
        while i < len(index):
            n = index[i]
            self.firsts.append(index[i + 1 : i + 1 + n])
            self.places.append(struct.unpack_from("<QQ", index, i + 1 + n))
            i += 17 + n
        bloom = self.file.read_at(bloom_length, bloom_at)
        self.bits, self.bloom = struct.unpack("<Q", bloom[:8])[0], bloom[8:]

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, length = self.places[block]
        data, i, key = _unpack(self.file.read_at(length, at)), 0, b""
        while i < len(data):
            shared, rest, width, n = _HEAD.unpack_from(data, i)
            i += _HEAD.size
            key = key[:shared] + data[i : i + rest]
            yield key, np.frombuffer(data, f"<u{width}", n, i + rest)
            i += rest + width * n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.places)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def get(self, identifier: int | None) -> np.ndarray | None:
        key = key_of(identifier)
        if any(not self.bloom[p >> 3] & (128 >> (p & 7)) for p in _probes(key, self.bits)):
            return None
        block = bisect_right(self.firsts, key) - 1
        while block > 0 and self.firsts[block] == key:  # repeated keys may begin in the block before
            block -= 1
        for at in range(max(block, 0), len(self.places)):
            if self.firsts[at] > key:
                break
            for k, ids in self._entries(at):
                if k == key:
                    return ids
        return None

    def close(self) -> None:
        self.file.close()


class Shards:
    """All shards of a manifest as one table: the ranges of identifiers lead to the shard, which is opened when it is asked for."""

    def __init__(self, manifest: DataFrame):
        rows = sorted(manifest.collect(), key=lambda r: key_of(r["first"]))  # one row per shard
        self.firsts, self.paths = [key_of(r["first"]) for r in rows], [r["path"] for r in rows]
        self._open: tuple[str, Shard] | None = None

    def get(self, identifier: int | None) -> np.ndarray | None:
        at = bisect_right(self.firsts, key_of(identifier)) - 1
        if at < 0:
            return None
        if self._open is None or self._open[0] != self.paths[at]:
            self.close()
            self._open = self.paths[at], Shard(self.paths[at])
        return self._open[1].get(identifier)

    def close(self) -> None:
        if self._open:
            self._open[1].close()
            self._open = None


MANIFEST = "path string, first long, last long, n_docs long, n_tokens long"


def _write(folder: str, tokenizer: str, end_id: int) -> Callable:
    def run(batches):
        encoder = writer = None
        first = last = None
        system, place = pafs.FileSystem.from_uri(folder)
        name = f"{place}/{uuid.uuid4().hex}.sst"
        for batch in batches:
            if writer is None and batch.num_rows:
                encoder = encoder_of(tokenizer, end_id)
                system.create_dir(place, recursive=True)
                sink = system.open_output_stream(name)
                writer = ShardWriter(sink)
            for i in range(0, batch.num_rows, 1000):
                rows = batch.slice(i, 1000)
                for identifier, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1)), strict=True):
                    first, last = identifier if not writer.count else first, identifier
                    writer.add(identifier, ids)
        if writer is not None:
            writer.close()
            sink.close()
            row = f"{folder}/{name.rpartition('/')[2]}", first, last, writer.count, writer.tokens
            yield pa.RecordBatch.from_arrays([pa.array([row[0]]), *(pa.array([x], pa.int64()) for x in row[1:])], ["path", "first", "last", "n_docs", "n_tokens"])

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """A lazy manifest of the shards that its run writes; materialise it once, and read the files that it lists."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by = [shards] if shards else []
    ordered = rows.repartitionByRange(*by, "doc_id").sortWithinPartitions("doc_id", F.md5("text"))
    return ordered.mapInArrow(_write(folder, tokenizer, end_id), MANIFEST)


def _entries_batch(out: dict[str, list[int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out, shard = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}, Shard(path)
            for identifier, ids in shard:
                for k, v in zip(out, (identifier, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    out[k].append(v)
                start += len(ids)
                if len(out["start"]) == 10_000:
                    yield _entries_batch(out)
                    out = {k: [] for k in out}
            shard.close()
            yield _entries_batch(out)


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per entry of the listed shards: doc_id, start among all ids in key order, n_tokens, ids_crc32."""
    before = F.sum("n_tokens").over(Window.orderBy("first", "last", "path").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.withColumn("start", F.coalesce(before, F.lit(0)))  # one row per shard
    return files.select("path", "start").repartition(max(1, manifest.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Writes shards and reads them back. With ``folder`` the shards and their manifest (``<folder>/manifest``, Parquet) are there to stay;
    without, they go to the shared scratch folder, which ends with the driver."""
    spark = docs.sparkSession
    if folder is None:
        scratch = Scratch(spark, "tokens")
        return read_shards(scratch.keep(write_shards(docs, scratch.path("shards"), tokenizer, id_col, text_col, end_id), "manifest"))
    write_shards(docs, f"{folder}/shards", tokenizer, id_col, text_col, end_id).write.parquet(f"{folder}/manifest")
    return read_shards(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
