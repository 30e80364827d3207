"""Conversation structure repair: the cheapest edits that make a conversation follow ``(system? (user assistant)+)?``.

Rows are judged first: blank, a copy of an earlier row of the conversation, truncated. Edits keep a row (0), give it the
role user or assistant (2), delete it (3; the only way with blanks and copies) or insert an empty turn (2); a truncated
row that stays costs 1. Roles count by their first character. Because a state of the pattern asks for one next role, the
letters of the edits (K, R, D, I) tell the repair; of the cheapest the ASCII-least letters count.

Spark passes letters and texts apart. The rows without their texts (a role's initial, three flags and the SHA-256 that
tells texts apart) meet by conversation, where conversations of one length form a time-major tensor: costs to go of four
states run backward turn by turn over all of them at once and are stored, then the edits are traced forward the same
way. A row takes one byte there, as much as its letter in the result; of a conversation of more than ``BLOCK`` turns only
the costs at the edges of blocks are stored, and those inside a block are computed again when the trace comes to it. The
letters then meet the texts, which pass their task as a sorted stream, one batch at a time.

Defined results: a null id is an id of its own, a null role or text reads as one space; rows of equal turn stand in the
order of the SHA-256 of role and text, so repeated rows are neighbours; an empty table gives no rows; other columns are
ignored; turns so far apart that their gaps pass 64 bits give the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.talk import changes, turn_digest, whole_groups

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn; STUCK is no state.
START, SYSTEM, USER, ASSISTANT, STUCK = range(5)
#: The state after the one turn that can be inserted or given its role in a state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Initials s, u, a, other by state: the state after the row is kept.
KEPT = np.array([[SYSTEM, STUCK, STUCK, STUCK], [USER, USER, STUCK, USER], [STUCK, STUCK, ASSISTANT, STUCK], [STUCK] * 4])
#: Initials that may follow each other: system user, user assistant, assistant user.
FOLLOWS = np.zeros((4, 4), bool)
FOLLOWS[[0, 1, 2], [1, 2, 1]] = True
SOUND, BLANK, COPY, CUT = range(4)
REROLE, DELETE, INSERT, NEVER = 2, 3, 2, 1 << 60
BLOCK = 1 << 16
_SPACE = " \t\n\x0b\x0c\r"


def _inserting(cost: np.ndarray) -> np.ndarray:
    """Costs by state when turns may be inserted first; a third insert would only come back to a state."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[:, NEXT])
    return cost


_END = _inserting(np.array([[0, NEVER, NEVER, 0]], np.int64))


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """codes: turns by conversations, initial + 4 * fault; end: costs by conversation and state after the last turn.

    Costs to go by turn, conversation and state; the fifth state is never left.
    """
    turns, n = codes.shape
    cost = np.full((turns + 1, n, 5), NEVER, np.int64)
    cost[turns, :, :4] = end
    each = np.arange(n)[:, None]
    for t in range(turns - 1, -1, -1):
        initial, fault, after = codes[t] & 3, codes[t] >> 2, cost[t + 1]
        stays = np.minimum(after[each, KEPT[initial]], REROLE + after[:, NEXT]) + (fault == CUT)[:, None]
        stays[(fault == BLANK) | (fault == COPY)] = NEVER
        cost[t, :, :4] = _inserting(np.minimum(DELETE + after[:, :4], stays))
    return cost


def trace(codes: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters by place and conversation, three places a turn (0: none), and the states after the last turn."""
    turns, n = codes.shape
    letters, each = np.zeros((3 * turns, n), np.uint8), np.arange(n)
    for t in range(turns):
        initial, fault, now, after = codes[t] & 3, codes[t] >> 2, cost[t], cost[t + 1]
        must, more, open_ = (fault == BLANK) | (fault == COPY), fault == CUT, np.ones(n, bool)
        for place in range(3):
            here, step, kept = now[each, state], NEXT[state], KEPT[initial, state]
            delete = DELETE + after[each, state] == here
            insert = INSERT + now[each, step] == here
            keep = ~must & (kept != STUCK) & (after[each, kept] + more == here)
            letter = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R")))) * open_
            letters[3 * t + place] = letter
            state = np.where((letter == ord("I")) | (letter == ord("R")), step, np.where(letter == ord("K"), kept, state))
            open_ = letter == ord("I")
            if not open_.any():
                break
    return letters, state


def cheapest(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of conversations of one length, and their letters by place (0: none)."""
    turns, n = codes.shape
    begins = range(0, turns, BLOCK)
    ends = [np.repeat(_END, n, axis=0)]
    for b in reversed(begins):
        stored = backward(codes[b : b + BLOCK], ends[-1])
        ends.append(stored[0, :, :4])
    total, state, found = ends.pop()[:, START], np.full(n, START), []
    for b in begins:
        end = ends.pop()
        letters, state = trace(codes[b : b + BLOCK], stored if b == 0 else backward(codes[b : b + BLOCK], end), state)
        found.append(letters)
    for _ in range(2):
        more = (state == SYSTEM) | (state == USER)
        found.append((more * ord("I")).astype(np.uint8)[None])
        state = np.where(more, NEXT[state], state)
    return total, np.concatenate(found)


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, turn, who, initial, fault, copies) to one report for each id."""
    for table in whole_groups(batches, "id"):
        copies = table["copies"].to_numpy()
        begin = np.cumsum(copies) - copies
        initial, fault = np.repeat(table["initial"].to_numpy(), copies).astype(np.uint8), np.repeat(table["fault"].to_numpy(), copies).astype(np.uint8)
        again = np.ones(len(fault), bool)  # of equal rows all but the first are copies
        again[begin] = False
        fault[again & (fault != BLANK)] = COPY
        rows = np.flatnonzero(changes(table["id"].combine_chunks()))
        first = begin[rows]
        sizes = np.diff(np.append(first, len(fault)))
        follows = np.ones(len(fault), bool)
        follows[1:] = FOLLOWS[initial[:-1], initial[1:]]
        follows[first] = True
        out = {name: np.add.reduceat(of.astype(np.int64), first) for name, of in (("blank", fault == BLANK), ("duplicate", fault == COPY), ("truncated", fault == CUT), ("illegal", ~follows))}
        turn, there = table["turn"].fill_null(0).to_numpy(), table["turn"].is_valid().to_numpy()
        fresh = there & np.concatenate([[True], (turn[1:] != turn[:-1]) | ~there[:-1]])
        fresh[rows] = there[rows]
        low = np.minimum.reduceat(np.where(there, turn, np.iinfo(np.int64).max), rows)
        high = np.maximum.reduceat(np.where(there, turn, np.iinfo(np.int64).min), rows)
        distinct = np.add.reduceat(fresh.astype(np.int64), rows)
        span = high.astype(np.uint64) - low.astype(np.uint64) - (distinct - 1).astype(np.uint64)
        out["gaps"] = np.where(distinct > 0, np.minimum(span, np.uint64(np.iinfo(np.int64).max)), 0).astype(np.int64)
        out["cost"], audits = np.zeros(len(rows), np.int64), np.empty(len(rows), object)
        code = initial + 4 * fault
        for size in np.unique(sizes):  # a bucket of conversations of one length
            some = np.flatnonzero(sizes == size)
            out["cost"][some], letters = cheapest(code[first[some] + np.arange(size)[:, None]])
            for at, column in zip(some.tolist(), letters.T, strict=True):
                audits[at] = column[column > 0].tobytes().decode()
        yield pa.RecordBatch.from_arrays([table["id"].combine_chunks().take(pa.array(rows)), *(pa.array(out[c]) for c in _COUNTS), pa.array(audits, pa.string())], ["id", *_COUNTS, "audit"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A report row, then the conversation's rows, again and again: the reports with place 0 and the repaired turns."""
    audit, at, state, place = "", 0, START, 0
    names = {USER: "user", ASSISTANT: "assistant"}
    for batch in batches:
        take, places, edits, roles, texts = [], [], [], [], []

        def put(row: int, edit: str | None, role: str | None, text: str | None):
            take.append(row), places.append(place), edits.append(edit), roles.append(role), texts.append(text)  # noqa: B023

        ids, role_of, text_of, is_row = (batch.column(c) for c in ("id", "role", "text", "is_row"))
        for row, line in enumerate(is_row.to_pylist()):
            if not line:
                audit, at, state, place = batch.column("audit")[row].as_py(), 0, START, 0
                put(row, None, None, None)
            while at < len(audit):
                edit = audit[at]
                if not line and edit != "I":
                    break
                if edit == "I" or edit == "R":
                    state = int(NEXT[state])
                    place += 1
                    put(row, edit, names[state], "" if edit == "I" else text_of[row].as_py())
                elif edit == "K":
                    role = role_of[row].as_py()
                    state = int(KEPT["sua".index(role[0]), state])
                    place += 1
                    put(row, edit, role, text_of[row].as_py())
                at += 1
                if edit != "I":  # the row is done; inserted turns that follow come at once
                    line = False
        if take:
            reports = [pa.array([batch.column(c)[r].as_py() if p == 0 else None for r, p in zip(take, places, strict=True)], batch.column(c).type) for c in (*_COUNTS, "audit")]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take)), pa.array(places, pa.int64()), pa.array(edits, pa.string()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), *reports], ["id", "place", "edit", "role", "text", *_COUNTS, "audit"])


def edited(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (id, place, edit, role, text, report columns): of each conversation its report with place 0, then its repaired turns
    from place 1, in one run of one partition, in order."""
    rows = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    rows = rows.withColumn("who", turn_digest(F.col("role"), F.col("text")))
    rest, initial = F.rtrim("text", F.lit(_SPACE)), F.left("role", F.lit(1))
    fault = F.when(rest == "", BLANK).when(~F.right(rest, F.lit(1)).isin(*".!?"), CUT).otherwise(SOUND)
    letters = rows.select("id", "turn", "who", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"), fault.alias("fault"))
    letters = letters.groupBy("id", "turn", "who", "initial", "fault").agg(F.count(F.lit(1)).alias("copies"))
    seen = letters.groupBy(F.col("id").alias("of"), F.col("who").alias("same")).agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = letters.join(seen, F.col("id").eqNullSafe(F.col("of")) & (F.col("who") == F.col("same")), "left")
    later = F.col("n").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("fault") != BLANK)
    judged = judged.select("id", "turn", "who", "initial", F.when(later, COPY).otherwise(F.col("fault")).alias("fault"), "copies")
    kind = rows.schema["id"].dataType.simpleString()
    reports = judged.repartition("id").sortWithinPartitions("id", "turn", "who").mapInArrow(_audits, f"id {kind}, {_REPORT}")
    both = rows.withColumn("is_row", F.lit(True)).unionByName(reports.withColumn("is_row", F.lit(False)), allowMissingColumns=True)
    stream = both.repartition("id").sortWithinPartitions("id", "is_row", "turn", "who")
    return stream.mapInArrow(_edited, f"id {kind}, place long, edit string, role string, text string, {_REPORT}")


def repair(conversations: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """The repaired conversations: (id, place from 1, edit, role, text)."""
    return edited(conversations, id_col, **columns).where("place > 0").select(F.col("id").alias(id_col), "place", "edit", "role", "text")


def reports(conversations: DataFrame, id_col: str = "conv_id", **columns: str) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, cost and audit."""
    return edited(conversations, id_col, **columns).where("place = 0").select(F.col("id").alias(id_col), *_COUNTS, "audit")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream of ``edited`` to a report for each conversation with the SHA-256 of its repaired lines."""
    report, digest = None, hashlib.sha256()
    columns = ["id", *_COUNTS, "audit"]
    for batch in batches:
        done, ready = [], []
        roles, texts, places = batch.column("role"), batch.column("text"), batch.column("place").to_pylist()
        for row, place in enumerate(places):
            if place == 0:
                if report is not None:
                    done.append(report), ready.append(digest.hexdigest())
                report, digest = batch.slice(row, 1).select(columns), hashlib.sha256()
            else:
                digest.update(f"{'' if place == 1 else '\n'}{roles[row].as_py()}:{texts[row].as_py()}".encode())
        if done:
            yield _with_digests(done, ready)
    if report is not None:
        yield _with_digests([report], [digest.hexdigest()])


def _with_digests(done: list[pa.RecordBatch], ready: list[str]) -> pa.RecordBatch:
    met = pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    return pa.RecordBatch.from_arrays([*met.columns, pa.array(ready)], [*met.schema.names, "repaired_sha256"])


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after a damage that the CRC of id and turn chooses: some dropped, some emptied, some without
    their ends of sentences, some twice, some with the role user. Nulls read as one space."""
    def said(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    mark = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), mark.alias("mark")).where("mark <> 0")
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "mark")
    return rows.withColumn("copy", F.explode(F.when(F.col("mark") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("mark", "copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    stream = edited(damage(talk))
    kind = stream.schema["id"].dataType.simpleString()
    found = stream.mapInArrow(_digests, f"id {kind}, {_REPORT}, repaired_sha256 string")
    every = talk.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    nothing = hashlib.sha256().hexdigest()
    return every.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
