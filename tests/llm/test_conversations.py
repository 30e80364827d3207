"""Conversation operators against plain programs."""

from __future__ import annotations

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from skein.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """rows: (role, text) in order. Faults by row, least cost, ASCII-least letters and the repaired lines, by trying every edit."""
    faults, seen = [], set()
    for role, text in rows:
        rest = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)

    def after(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        want = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[want]
        if inserted < 3:
            c, a, t = best(i, want, inserted + 1)
            found.append((c + 2, "I" + a, (f"{name}:", *t)))
        if i < len(rows):
            role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, t))
            if faults[i] in ("", "truncated"):
                more = int(faults[i] == "truncated")
                c, a, t = best(i + 1, want, 0)
                found.append((c + 2 + more, "R" + a, (f"{name}:{text}", *t)))
                kept = after(state, role[:1])
                if kept:
                    c, a, t = best(i + 1, kept, 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = {n: faults.count(n) for n in ("blank", "duplicate", "truncated")}
    return counts | {"illegal": illegal, "cost": cost, "audit": audit, "lines": list(lines)}


def told(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def in_order(rows):
    """(turn, role, text) with nulls as one space, by turn, nulls first; rows of one turn by their digest."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, told(r[1], r[2])))


def plain_op11(rows):
    talks = {}
    for conv, turn, role, text in rows:
        kept = talks.setdefault(conv, [])
        mark = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if mark == 1:
            text = ""
        if mark == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if mark == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(mark, 1)
    out = {}
    for conv, kept in talks.items():
        turns = {t for t, _, _ in kept if t is not None}
        got = plain_repair(tuple((r, x) for _, r, x in in_order(kept)))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(got["lines"]).encode()).hexdigest()
        out[conv] = (gaps, got["blank"], got["duplicate"], got["truncated"], got["illegal"], got["cost"], got["audit"], digest)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_talk(n, seed):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.choice((0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 12))):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "uploader", None))
            text = rng.choice(("Yes.", "Yes.", "No", "Why?", " ", "", None, "a ", "Ah! \n", f"{turn} said.", "ünd so. weiter!"))
            rows.append((conv, rng.choice((turn, turn, turn, turn // 2, None, 3 * turn)), role, text))
    rng.shuffle(rows)
    return rows


def op11_of(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.op11_repair(spark, str(tmp_path)).collect()}


def test_op11_equals_plain_program(spark, tmp_path):
    rows = random_talk(400, 7) + [(None, None, "user", "Hm."), (None, 4, None, None), (-5, -3, "assistant", "So."), (-5, 2**40, "user", "So?")]
    rows += [(9_001, 1, "user", "Twice.")] * 3
    assert op11_of(spark, tmp_path, rows) == plain_op11(rows)


def test_op11_on_the_test_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.op11_repair(spark, sf).collect()}
    assert got == plain_op11(rows)


def test_op11_without_rows(spark, tmp_path):
    assert op11_of(spark, tmp_path, []) == {}


def test_long_conversations_meet_in_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    codes = (rng.integers(0, 4, (97, 5)) + 4 * rng.integers(0, 4, (97, 5))).astype(np.uint8)
    whole = repair.cheapest(codes)
    monkeypatch.setattr(repair, "BLOCK", 10)
    parts = repair.cheapest(codes)
    assert (whole[0] == parts[0]).all()
    for a, b in zip(whole[1].T, parts[1].T):
        assert a[a > 0].tobytes() == b[b > 0].tobytes()


def test_a_conversation_of_many_turns(spark):
    rows = [(1, t, ("user", "assistant", "assistant", "system")[t * 7 % 11 % 4], f"Turn {t}{'.' if t % 5 else ''}") for t in range(3000)]
    rows += [(0, 0, "user", "Short."), (2, 0, "user", "x" * 3_000_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    for r in repair.repair(df).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append((r["place"], f"{r['role']}:{r['text']}"))
    for conv in (0, 1, 2):
        got = [x for _, x in lines[conv]]
        assert [p for p, _ in lines[conv]] == list(range(1, len(got) + 1))
        if conv == 1:
            told_roles = "".join(x[0] for x in got)
            assert told_roles.removeprefix("s") == "ua" * (len(got) // 2)
        else:
            assert got == plain_repair(tuple((r, x) for c, _, r, x in rows if c == conv))["lines"]
    report = {r["conv_id"]: r for r in repair.reports(df).collect()}
    assert len(report[1]["audit"].replace("I", "")) == 3000


def test_other_columns_and_names(spark):
    df = spark.createDataFrame([("b", 1, "user", "Hi.", 5), ("b", 2, "user", "Hi.", 5)], "talk string, at int, who string, said string, place int")
    got = repair.repair(df, "talk", turn_col="at", role_col="who", text_col="said").orderBy("place").collect()
    assert [tuple(r) for r in got] == [("b", 1, "K", "user", "Hi."), ("b", 2, "I", "assistant", "")]
    report = repair.reports(df, "talk", turn_col="at", role_col="who", text_col="said").collect()
    assert [(r["duplicate"], r["audit"]) for r in report] == [(1, "KDI")]


@pytest.mark.parametrize("rows", [(("system", "Be."),), (("user", "A."), ("user", "B.")), (("assistant", "A"), ("system", "S."), ("user", "")), ()])
def test_kernel_on_small_cases(rows):
    want = plain_repair(tuple(rows))
    codes = []
    for role, text in rows:
        codes.append(max("sua".find(role[0]), 0) + 4 * (1 if not text else 0 if text[-1] == "." else 3))
    cost, letters = repair.cheapest(np.array(codes, np.uint8).reshape(-1, 1))
    assert (int(cost[0]), letters[:, 0][letters[:, 0] > 0].tobytes().decode()) == (want["cost"], want["audit"])
