import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL
from helpers import LONG, ODD, PROSE, empty_table, odd_table, rows_of
from quarry.llm import minhash, suffixes
from quarry.llm.components import components
from quarry.llm.registry import ORACLE, QUERIES


def word_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def plain_components(docs):
    """Every pair compared, by an index of the shingles."""
    sets = {k: word_set(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for k in sorted(sets):
        near = defaultdict(int)
        for s in sets[k]:
            for other in held[s]:
                near[other] += 1
            held[s].append(k)
        for other, both in near.items():
            if 100 * both >= 75 * (len(sets[k]) + len(sets[other]) - both):
                a, b = sorted((find(k), find(other)))
                root[b] = a
    return sorted(((k, len(s), find(k), find(k) == k) for k, s in sets.items()), key=repr)


def by_sql(name, sf, cols):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ", ".join(f'"{c}"' for c in cols)
    return sorted(con.execute(f"SELECT {names} FROM ({ORACLE[name]})").fetchall(), key=repr)


COLS = ["doc_id", "n_shingles", "component_id", "kept"]


def near_copies(n, seed, words=200):
    """Copies of one text with more and more words changed, among other texts that share a passage."""
    draw = random.Random(seed)
    own = [f"x{draw.randrange(10**6)}" for _ in range(words)]
    passage = " ".join(f"p{k}" for k in range(60))
    out = []
    for k in range(n):
        copy = list(own)
        for _ in range(draw.choice([0, 1, 2, 4, 6, 8, 12])):
            copy[draw.randrange(words)] = f"y{draw.randrange(10**6)}"
        out.append(" ".join(copy))
        out.append(f"{passage} " + " ".join(f"z{draw.randrange(10**6)}" for _ in range(draw.choice([5, 30, 100]))))
    return list(enumerate(out))


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in ODD if r[0] is not None]
    df = odd_table(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert rows_of(minhash.near_duplicates(df), *COLS) == plain_components(dict(rows).items())
    every = minhash.near_duplicates(odd_table(spark)).collect()
    assert len(every) == len(ODD)
    assert [(r.component_id, r.kept) for r in every if r.doc_id is None] == [(None, True)] * 2
    assert minhash.near_duplicates(empty_table(spark)).count() == 0
    kept = minhash.drop_near_duplicates(odd_table(spark))
    assert kept.columns == odd_table(spark).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [0, 1, 2, 3, 4, 7, 8, 9]


def test_rows_without_id_join_the_near_stage(spark):
    other = " ".join(f"o{k}" for k in range(160))
    rows = [(4, PROSE, "p"), (None, PROSE + " end", "q"), (None, other, "r"), (None, other + " end", "s"),
            (None, other + "  end", "t"), (None, "one two", "u"), (None, "", "v"), (9, other[:300], "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").repartition(3)
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    kept = [r[0] for r in rows_of(got, "_id")]
    assert [k for k in kept if k not in "rst"] == ["p", "u", "v", "w"] and len(kept) == 5


@pytest.mark.parametrize("blocks", [(4096, 2_000_000), (16, 3000)])
def test_group_of_near_copies(spark, monkeypatch, blocks):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", blocks[1])
    docs = near_copies(150, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows_of(minhash.near_duplicates(df), *COLS) == plain_components(docs)


def test_borderline_pairs_are_found(spark):
    draw, docs = random.Random(6), []
    for k in range(0, 400, 2):
        words = [f"q{draw.randrange(10**7)}" for _ in range(104)]
        docs.append((k, " ".join(words)))
        # one stretch of new words at the end leaves n of 100 shingles
        n = draw.choice([84, 85, 86, 87])
        docs.append((k + 1, " ".join(words[: n + 4] + [f"r{draw.randrange(10**7)}" for _ in range(100 - n)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_components(docs)
    assert 50 < sum(not w[3] for w in want) < 190
    assert rows_of(minhash.near_duplicates(df), *COLS) == want


def test_pigeonhole_bound():
    """Signatures that differ in fewer than 2 places per chunk share a masked chunk."""
    draw = random.Random(7)
    for _ in range(300):
        wrong = set(draw.sample(range(minhash.CHUNKS * minhash.WIDTH), 2 * minhash.CHUNKS - 1))
        assert min(sum(c * minhash.WIDTH + k in wrong for k in range(minhash.WIDTH)) for c in range(minhash.CHUNKS)) <= 1


def test_near_query(spark):
    for sf in (SF_SMALL, SF_MID):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        got = rows_of(QUERIES["op5_near_dedup"](spark, sf), *COLS)
        assert got == plain_components(docs) == by_sql("op5_near_dedup", sf, COLS)


def test_components(spark):
    draw = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(40)]
    edges += [(500, k) for k in range(501, 700)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {x: root[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_passages(docs, least=50):
    grams, words = {}, {}
    for k, text in sorted(docs):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        body = [text[a:b] for a, b in spans]
        words[k] = spans, [tuple(body[n : n + least]) for n in range(len(body) - least + 1)]
        for g in words[k][1]:
            grams.setdefault(g, set()).add(k)
    out = []
    for k, (spans, own) in words.items():
        hits = [n for n, g in enumerate(own) if len(grams[g]) > 1]
        runs = []
        for n in hits:
            if runs and n - runs[-1][-1] < least:
                runs[-1].append(n)
            else:
                runs.append([n])
        for r in runs:
            first = min(min(grams[own[n]]) for n in r)
            out.append((k, spans[r[0]][0], spans[r[-1] + least - 1][1], r[-1] - r[0] + least, first))
    return sorted(out, key=repr)


SPANS = ["doc_id", "start", "end", "n_words", "first_doc_id"]


def test_odd_rows_have_their_passages(spark):
    docs = {r[0]: r[1] for r in ODD if r[0] is not None}
    docs |= {20: "pre " + LONG[5000:9000], 21: "\n" + PROSE + "\t", 22: "de " * 300, 23: "x " + "de " * 120, 24: "é " * 60}
    df = spark.createDataFrame([(k, t, "p", 1) for k, t in docs.items()] + [(6, docs[6], "p", 1), (None, PROSE, "p", 1)],
                               "doc_id long, text string, start string, end long").repartition(3)
    want = plain_passages(docs.items())
    assert {w[0] for w in want} == {3, 4, 5, 6, 20, 21, 22, 23}
    assert rows_of(suffixes.repeated_passages(df), *SPANS) == want
    assert suffixes.repeated_passages(empty_table(spark)).count() == 0


def test_shared_passages_of_every_length(spark):
    draw, docs = random.Random(9), []
    fresh = lambda n: [f"f{draw.randrange(10**7)}" for _ in range(n)]
    for k in range(0, 200, 2):
        shared = fresh(draw.choice([20, 48, 49, 50, 51, 55, 90]))
        for j in (0, 1):
            docs.append((k + j, " ".join(fresh(draw.randrange(80)) + shared + fresh(draw.randrange(80)))))
    hot = fresh(60)
    docs += [(k, " ".join(fresh(30) + hot + fresh(30))) for k in range(300, 600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    want = plain_passages(docs)
    assert {w[3] for w in want} >= {50, 51, 55, 90, 60}
    assert rows_of(suffixes.repeated_passages(df), *SPANS) == want


def test_grams_and_minimisers():
    h = np.random.default_rng(1).integers(0, 1 << 63, 300, np.uint64)
    g = suffixes.gram_hashes(np.concatenate([h, h]), 30)
    assert (g[:271] == g[300:]).all() and len(set(g[:300].tolist())) == 300
    m = suffixes.minimisers(g, 21)
    assert all(g[p] == g[k : k + 21].min() and k <= p < k + 21 for k, p in enumerate(m))


def test_suffix_query(spark):
    for sf in (SF_SMALL, SF_MID):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        got = rows_of(QUERIES["op4_suffix_dedup"](spark, sf), *SPANS)
        assert got == plain_passages(docs) == by_sql("op4_suffix_dedup", sf, SPANS)


def test_ids_are_checked_before_any_job(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for operator in (minhash.near_duplicates, minhash.drop_near_duplicates, suffixes.repeated_passages):
        with pytest.raises(ValueError):
            operator(df)


def test_the_highest_id_and_rows_without_one(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(2**63 - 1, text, "a"), (None, text + " end", "b"), (5, "other words " * 9, "c"), (None, "alone " * 7, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r["_gone"] for r in kept.collect()) == ["a", "c", "d"]
