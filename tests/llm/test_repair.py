import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import SF_MID, SF_SMALL
from helpers import rows_of
from pyspark.sql import functions as F
from quarry.llm import repair
from quarry.llm.registry import QUERIES
from quarry.llm.repair import CLOSING, Grammar, finish, repair_conversations, repair_damaged

COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WS = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """rows: (initial, must_go, broken).  Least (cost, letters), from the right."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, ""))
        else:
            initial, gone, broken = rows[i]
            ways.append(add(best(i + 1, state, 0), 3, "D"))
            if not gone:
                if (state, initial) in step:
                    ways.append(add(best(i + 1, step[state, initial], 0), int(broken), "K"))
                for to in "ua":
                    if (state, to) in step:
                        ways.append(add(best(i + 1, step[state, to], 0), 2 + broken, "R"))
        if inserted < 3:
            for to in "ua":
                if (state, to) in step:
                    ways.append(add(best(i, step[state, to], inserted + 1), 2, "I"))
        return min((w for w in ways if w), default=None)

    def add(rest, cost, letter):
        return rest and (rest[0] + cost, letter + rest[1])

    return best(0, "", 0)


def repaired(rows, audit):
    state, out, at = "", [], 0
    for letter in audit:
        put = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((put, ""))
        else:
            role, text = rows[at]
            at += 1
            if letter == "D":
                continue
            out.append((role if letter == "K" else put, text))
        state = out[-1][0][:1]
    assert at == len(rows)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return out


def plain(conv, rows):
    """One conversation: rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marks, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.strip(WS)
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else 3
        seen.add((role, text))
        if fault < 3:
            counts[fault] += 1
        marks.append((role[:1], fault < 2, fault == 2))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    cost, audit = cheapest(tuple(marks))
    lines = "\n".join(f"{r}:{t}" for r, t in repaired([r[1:] for r in rows], audit))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
    return conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


def plain_table(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    return sorted((plain(c, r) for c, r in by.items()), key=repr)


def plain_damaged(rows):
    out, convs = [], set()
    for conv, turn, role, text in rows:
        convs.add(conv)
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    gone = convs - {r[0] for r in out}
    nothing = hashlib.sha256(b"").hexdigest()
    return sorted(plain_table(out) + [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c in gone], key=repr)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_equals_the_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert rows_of(QUERIES["op13_conversation_repair"](spark, sf), *COLS) == plain_damaged(rows)


def test_grammar_products_equal_the_cheapest_edits():
    rng = random.Random(5)
    for least in (2, 8, 1000):
        sequences = [[rng.choice((0, 2, 2, 3, 4, 4, 5, 6, 8)) for _ in range(rng.randrange(1, 40))] for _ in range(300)]
        sequences += [[2] * 33, [2, 4] * 20, [8] * 9, [0], [1], [6, 7]]
        grammar = Grammar(sequences, least)
        cost, rank, steps, back = grammar.products()
        ends = [finish(cost[k, 0], rank[k, 0]) for k in range(len(sequences))]
        audits = grammar.audits(steps, back, [0] * len(sequences), ends)
        for k, sequence in enumerate(sequences):
            rows = tuple(("sua-"[s // 2] if s != 8 else "-", s == 8, s != 8 and bool(s % 2)) for s in sequence)
            got = int(cost[k, 0, ends[k]]) + 2 * CLOSING[ends[k]], audits[k] + "I" * CLOSING[ends[k]]
            assert got == cheapest(rows)
        assert (least > 100) == (not grammar.rules)


def odd_rows():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "ümlaut", "u", "a"]
    texts = ["Yes.", "no", "What?", "", " \t", None, "Done!", "é.", "x\ny.", "a. \n", "…", "."]
    rows = [(k % 97, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for k in range(1500)]
    rows += [(None, 3, "user", "Hi."), (None, None, "assistant", "Hi."), (None, 3, "user", "Hi.")]
    rows += [(1000, -(2**63), "user", "a."), (1000, 2**62, "assistant", "b.")]
    rows += [(1001, 0, "user", "long " * 100_000 + "."), (1001, 1, "assistant", "ok.")]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clash = {c: F.lit("z") for c in ("conv", "block", "later", "said", "kind", "_conv", "_said", "path", "audit", "cost", "_draw")}
    df = df.withColumns(clash)
    assert rows_of(repair_conversations(df), *COLS) == plain_table(rows)
    assert rows_of(repair_damaged(df), *COLS) == plain_damaged(rows)
    assert repair_conversations(df.limit(0)).count() == 0 == repair_damaged(df.limit(0)).count()
    with pytest.raises(ValueError):
        repair_conversations(df.withColumn("turn", F.lit("1")))


def test_conversations_of_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_SHIFT", 5)
    rng = random.Random(2)
    texts = [f"t{k}." for k in range(300)] + ["broken", "", "x"]
    roles = ["user", "assistant"]
    rows = [(7, k // 3, roles[k % 2] if rng.random() < 0.8 else rng.choice(["system", *roles]), rng.choice(texts)) for k in range(420)]
    rows += [(8, t, "user", f"q{t}.") for t in (None, 5, 900, 5000)]
    rows += [(c, t, roles[t % 2], f"{c} {t}.") for c in range(20, 60) for t in range(6)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(repair_conversations(df), *COLS) == plain_table(rows)


def test_chunks_by_rows_and_characters(monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 7)
    rows = [("c", 0, 1, "user", f"{k:03}", False) for k in range(30)]
    sizes = [len(c.symbols) for c in repair.chunks_of(rows)]
    assert sizes == [7, 7, 7, 7, 2]
    monkeypatch.setattr(repair, "CHUNK_CHARS", 6)
    assert [len(c.symbols) for c in repair.chunks_of(rows)] == [2] * 15
