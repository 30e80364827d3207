"""License scan by template-markup matching.

A template is wording with regions in mark-up:

    <<optional>> ... <</optional>>   wording that may be missing
    <<var:1-6>>                      any words, here one to six

It is compiled into an automaton over tokens whose states are positions in the wording. An accepted stretch of a text holds
all mandatory words, in order and exactly. The automaton starts only where a text has the template's first mandatory words,
which a vectorised search over word hashes finds, so the work follows the places and not the texts. Optional regions
may stand before them: what is accepted with such a region is accepted without it, from the mandatory words on.

The base labels come from fixed phrases, which are templates without regions. Score: 1 for a text with a whole license or a notice,
0.9 for a base phrase, 0.5 for the opening of a license only, else 0.

Defined results: a null text is empty, and a text without words has no label, no place and score 0; every place counts,
overlapping ones too; repeated rows give repeated results; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import textbytes as tb

# fixed values: base phrases and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# fixed values: the wording of licenses and notices, lower case, with their optional and replaceable regions
_MIT = (
    "<<optional>> <<optional>> the <</optional>> mit license <<optional>> mit <</optional>> <</optional>> <<optional>> copyright <<optional>> c <</optional>> <<var:1-10>> <</optional>> "
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
    "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
    "the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>> including the next paragraph <</optional>> "
    "shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not "
    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:1-8>> be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>> <<var:1-1>> <</optional>> "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>> <<var:1-1>> <</optional>> "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution <<optional>> <<optional>> <<var:1-1>> <</optional>> neither the name of <<var:1-12>> nor the names of <<var:1-3>> may be used to endorse or "
    "promote products derived from this software without specific prior written permission <</optional>> this software is provided by <<var:1-8>> as is and any express or "
    "implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:1-8>> be "
    "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data "
    "or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any "
    "way out of the use of this software even if advised of the possibility of such damage"
)
_ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
    "notice appear in all copies the software is provided as is and <<var:1-6>> disclaims all warranties with regard to this software including all implied warranties of "
    "merchantability and fitness in no event shall <<var:1-6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
    "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
#: Label and template. ``license`` is a whole license text, ``notice`` a sentence that grants by name, ``opening`` the first sentence of a
#: license only, which says nothing about the rest.
TEMPLATES = (
    ("license:mit", _MIT),
    ("license:bsd", _BSD),
    ("license:isc", _ISC),
    ("notice:apache-2", "licensed under the apache license <<optional>> version <</optional>> 2 0"),
    ("notice:gpl", "licensed under the <<optional>> terms of the <</optional>> gnu <<optional>> lesser <</optional>> <<optional>> affero <</optional>> general public license <<optional>> version <<var:1-1>> <</optional>>"),
    ("notice:cc", "licensed under cc by <<optional>> nc <</optional>> <<optional>> sa <</optional>> <<optional>> nd <</optional>> <<var:1-1>> 0"),
    ("notice:cc", "licensed under a creative commons attribution <<var:0-4>> license"),
    ("notice:mit", "released under the mit license"),
    ("notice:mit", "licensed under the <<optional>> terms of the <</optional>> mit license"),
    ("notice:copyright", "all rights reserved <<var:0-8>> redistribution <<optional>> in any form <</optional>> is prohibited"),
    ("opening:mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("opening:bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
#: By the strongest kind of label; base phrases count 0.9.
SCORES = {"license": 1.0, "notice": 1.0, "opening": 0.5}

_MARK = re.compile(r"<<(/?)(optional|var)(?::(\d+)-(\d+))?>>|(\S+)")
ANCHOR = 3


@dataclass(frozen=True)
class Automaton:
    """States are numbers; ``moves[s]`` has (word or None for any, next state); ``free[s]`` what s reaches without a word."""

    label: str
    anchor: tuple[str, ...]
    moves: tuple[tuple[tuple[str | None, int], ...], ...]
    free: tuple[frozenset[int], ...]
    final: int
    longest: int

    def match(self, words: list[str]) -> int:
        """The length of the longest accepted prefix of words, 0 if there is none."""
        states, best = self.free[0], 0
        for n, word in enumerate(words[: self.longest], 1):
            states = frozenset(t for s in states for want, to in self.moves[s] if want is None or want == word for t in self.free[to])
            if not states:
                break
            if self.final in states:
                best = n
        return best


def compile_template(label: str, template: str) -> Automaton:
    moves, empty, open_at = [[]], [set()], []
    words, first, plain = 0, [], True

    def state() -> int:
        moves.append([])
        empty.append(set())
        return len(moves) - 1

    for m in _MARK.finditer(template):
        here = len(moves) - 1
        if m[5]:
            moves[here].append((m[5], state()))
            words += 1
            if plain and not open_at:
                first.append(m[5])
        elif m[2] == "var":
            plain = plain and bool(open_at)
            for i in range(int(m[4])):
                if i >= int(m[3]):
                    empty[len(moves) - 1].add(("end", len(open_at), m.start()))
                moves[len(moves) - 1].append((None, state()))
                words += 1
            end = len(moves) - 1
            for s in empty:
                if ("end", len(open_at), m.start()) in s:
                    s.discard(("end", len(open_at), m.start()))
                    s.add(end)
        elif m[1]:
            empty[open_at.pop()].add(here)
        else:
            plain = not first  # a region may stand before the first mandatory words, but not among them
            open_at.append(here)
    if open_at or len(first) < ANCHOR:
        raise ValueError(f"a template needs closed regions and {ANCHOR} mandatory words first: {template}")

    def reach(s: int) -> frozenset[int]:
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += empty[x]
        return frozenset(seen)

    return Automaton(label, tuple(first[:ANCHOR]), tuple(map(tuple, moves)), tuple(map(reach, range(len(moves)))), len(moves) - 1, words)


def _hash_of(words: tuple[str, ...]) -> np.uint64:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = tb.words(data, np.array([0, len(data)]), tb.PLAIN)
    return tb.shingles(tb.Spans(data).hash(starts, ends), len(words))[0]


SCHEMA = "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(phrases: dict[str, str], templates: tuple[tuple[str, str], ...]) -> Callable:
    def run(batches):
        automata = [compile_template(*t) for t in templates]
        for batch in batches:
            data, offsets = tb.batch_of(batch.column(1))
            for lo, hi in tb.runs(offsets):
                yield _scan_run(batch.column(0).slice(lo, hi - lo), *tb.part(data, offsets, lo, hi), phrases, automata)

    return run


def _scan_run(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, phrases: dict[str, str], automata: list[Automaton]) -> pa.RecordBatch:
    low = tb.LOWER[data]
    starts, ends, first = tb.words(low, offsets, tb.PLAIN)
    hashes = tb.Spans(low).hash(starts, ends)
    text = low.tobytes()

    def said(at: int, n: int) -> list[str]:
        return [text[s:e].decode("utf-8", "replace") for s, e in zip(starts[at : at + n], ends[at : at + n], strict=True)]

    n_docs = len(offsets) - 1
    places: list[list[int]] = [[] for _ in range(n_docs)]
    base: list[set[str]] = [set() for _ in range(n_docs)]
    full: list[set[str]] = [set() for _ in range(n_docs)]

    def found(words: tuple[str, ...]):
        for at in np.flatnonzero(tb.shingles(hashes, len(words)) == _hash_of(words)):
            doc = int(np.searchsorted(first, at, "right")) - 1
            if at + len(words) <= first[doc + 1] and said(at, len(words)) == list(words):
                yield doc, int(at)

    for phrase, label in phrases.items():
        for doc, at in found(tuple(phrase.split())):
            places[doc].append(at - int(first[doc]))
            base[doc].add(label)
    for anchor in {a.anchor for a in automata}:
        for doc, at in found(anchor):
            words = said(at, int(min(max(a.longest for a in automata), first[doc + 1] - at)))
            full[doc] |= {a.label for a in automata if a.anchor == anchor and a.match(words)}
    join = [",".join(sorted(x)) for x in base], [",".join(sorted(x | y)) for x, y in zip(base, full, strict=True)]
    columns = {
        "doc_id": ids,
        "n_words": pa.array(np.diff(first), pa.int64()),
        "n_base": pa.array([len(x) for x in places], pa.int64()),
        "first_word": pa.array([min(x, default=None) for x in places], pa.int64()),
        "last_word": pa.array([max(x, default=None) for x in places], pa.int64()),
        "base_labels": pa.array(join[0], pa.string()),
        "labels": pa.array(join[1], pa.string()),
        "score": pa.array([max([0.9 * bool(b), *(SCORES.get(x.partition(":")[0], 1.0) for x in f)]) for b, f in zip(base, full, strict=True)], pa.float64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per input row, without a shuffle: n_words, base phrases' places and labels, all labels, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(phrases, templates), SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())).withColumnRenamed("doc_id", id_col)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _pattern(template: str) -> str:
    """The template as a regular expression over words that each have one space before them."""
    out = ""
    for m in _MARK.finditer(template):
        if m[5]:
            out += " " + m[5]
        elif m[2] == "var":
            out += f"( [^ ]+){{{m[3]},{m[4]}}}"
        else:
            out += ")?" if m[1] else "("
    return out + " "


def _oracle() -> str:
    starts = " || ".join(f"list_filter(range(len(w)), lambda i: w[i+1:i+{len(p.split())}] = {p.split()!r})" for p in PHRASES)
    base = ", ".join(f"CASE WHEN contains(t, ' {p} ') THEN '{v}' END" for p, v in PHRASES.items())
    more = ", ".join(f"CASE WHEN regexp_matches(t, '{_pattern(p)}') THEN '{v}' END" for v, p in TEMPLATES)
    return f"""
WITH l AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
a AS (SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM l),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM a),
c AS (SELECT doc_id, len(w) AS n_words, {starts} AS p, list_filter([{base}], lambda x: x IS NOT NULL) AS bl, list_filter([{more}], lambda x: x IS NOT NULL) AS ml FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels, array_to_string(list_sort(list_distinct(bl || ml)), ',') AS labels,
       CASE WHEN len(list_filter(ml, lambda x: x NOT LIKE 'opening:%')) > 0 THEN 1.0 WHEN len(bl) > 0 THEN 0.9 WHEN len(ml) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM c
"""


ORACLE = _oracle()
