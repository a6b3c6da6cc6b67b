import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL
from helpers import ODD, PROSE, empty_table, odd_table
from hypothesis import given, settings
from hypothesis import strategies as st
from quarry.llm import fingerprints as fp
from quarry.llm import quality
from quarry.llm.registry import QUERIES


def slow_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], (last + 1 if x == y else max(row[k], row[k - 1]))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=90), st.lists(st.sampled_from("abcdef"), max_size=90))
def test_common_subsequence(a, b):
    assert fp.common_subsequence(a, b) == slow_subsequence(a, b)


def test_boundaries_follow_content(monkeypatch):
    raw = PROSE.encode() * 20
    one = fp.boundaries(raw, 96)
    monkeypatch.setattr(fp, "STRETCH", 1000)
    assert fp.boundaries(raw, 96) == one
    shifted = fp.boundaries(b"xx" + raw, 96)[0]
    assert len({e + 2 for e in one[0]} & set(shifted)) >= len(one[0]) - 1


def test_likeness():
    draw = random.Random(1)
    text = " ".join(f"w{draw.randrange(9999)}" for _ in range(800))
    other = " ".join(f"w{draw.randrange(9999)}" for _ in range(800))
    same = fp.fingerprint(text)
    assert fp.likeness(same, fp.fingerprint(text)) == 1
    assert fp.likeness(same, fp.fingerprint(text.replace("w7", "x7", 1))) > 0.9
    assert 0.4 < fp.likeness(same, fp.fingerprint(fp.edited(text, other))) < 0.6
    assert 0.35 < fp.likeness(same, fp.fingerprint(fp.edited(text, ""))) < 0.85  # half the length
    assert fp.likeness(same, fp.fingerprint(other)) < 0.1
    assert fp.likeness(same, fp.fingerprint("")) == 0
    assert len(fp.fingerprint("ab " * 1_000_000)) < 600  # periodic text: signatures stay bounded


@pytest.mark.parametrize("period", [7, 12, 40])
def test_half_of_a_periodic_text(period):
    draw = random.Random(period)
    tried = 0
    while tried < 10:
        stretch = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(period))
        text = (stretch * 3000)[: 200 * period]
        size = fp.block_size(len(text))
        if len(fp.boundaries(text.encode(), size)[0]) < fp.MOST_CHUNKS:
            continue
        tried += 1
        other = " ".join(f"w{draw.randrange(9999)}" for _ in range(len(text) // 4))
        same, half = fp.fingerprint(text), fp.fingerprint(fp.edited(text, other))
        assert 0.4 < fp.likeness(same, half) < 0.65
        assert len(same.split(":")[1]) <= 2 * fp.MOST_CHUNKS
        assert fp.likeness(same, fp.fingerprint("xx" + text)) > 0.9  # the rest is cut alike


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.lists(st.integers(1, 400), max_size=400))
def test_signatures_are_bounded_without_a_rest(size, gaps):
    ends, n = np.cumsum(gaps).tolist(), fp.CHUNKS * size
    ends = [e for e in ends if e <= n]
    assert set(fp.thinned(bytes(n), ends, size)) <= set(ends)
    assert len(fp.signature(bytes(n), ends, size)) <= 2 * fp.MOST_CHUNKS


def plain(rows):
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for n, (k, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        e = fp.edited(t, after)
        a, b, c = map(fp.fingerprint, (t, e, after))
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=repr)


def test_odd_rows_and_their_successors(spark):
    got = sorted(map(tuple, fp.fingerprint_neighbours(odd_table(spark)).collect()), key=repr)
    assert got == plain([(r[0], r[1]) for r in ODD])
    assert fp.fingerprint_neighbours(empty_table(spark)).count() == 0
    one = fp.fingerprint_neighbours(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).collect()
    assert [tuple(r) for r in one] == plain([(1, "alone")])


def test_fingerprint_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op2_fingerprints"](spark, SF_SMALL).collect()), key=repr)
    assert got == plain(docs)


def test_pairs_are_learnt():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 3))
    y = (x @ [2.0, -1.0, 0.0] + draw.normal(scale=0.3, size=600) > -1).astype(int)
    model = quality.fit_pairs(x, y)
    s = quality.scores(x, model)
    assert ((s >= quality.CUT) == y).mean() > 0.95
    assert abs((s < quality.CUT).sum() - (y == 0).sum()) <= 1  # the threshold is a quantile
    assert quality.scores(x, quality.fit_pairs(x, np.ones(600, int))).tolist() == [quality.CUT] * 600


def test_odd_rows_are_scored(spark):
    labels = spark.createDataFrame([(4, 1), (3, 0), (99, 1), (None, 0), (5, None)], "doc_id long, quality int")
    for few in (labels, labels.limit(0)):
        got = quality.classify(odd_table(spark), few).collect()
        assert sorted([r.doc_id for r in got], key=repr) == sorted([r[0] for r in ODD], key=repr)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert quality.classify(empty_table(spark), labels).count() == 0
    kept = quality.keep_good(odd_table(spark), labels.limit(0))
    assert kept.count() == len(ODD) and kept.columns == odd_table(spark).columns


def test_held_out_labels_are_not_learnt(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) quality")
    a, b = quality.learn(docs, labels), quality.learn(docs, turned)
    assert a["w"].tolist() == b["w"].tolist() and a["at"] == b["at"]


def test_quality_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_quality"](spark, SF_MID).collect() if r.held_out and r.doc_id in labels]
    good = [r.score for r in rows if labels[r.doc_id]]
    bad = [r.score for r in rows if not labels[r.doc_id]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95


def test_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    assert quality.learn(docs, labels, sample=40)["w"].shape == (14,)


@pytest.mark.parametrize("n", [0, 1, 190, 193, 10**6])
def test_block_sizes(n):
    assert fp.block_size(n) * fp.CHUNKS >= n
