"""Token counts and packing, against the tokenizer libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from conftest import SF_SMALL
from helpers import ODD, empty_table, odd_table, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from quarry.llm.packing import Encoder, cuts, filling_levels, pack, public_vocabulary
from quarry.llm.registry import QUERIES
from quarry.llm.token_counts import Counter, load, prove_shortcut, token_counts
from tokenizers import Tokenizer

MODEL = public.path("piece_bpe_32k.model")
JSON = public.path("byte_bpe_50k.json")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TOK = Tokenizer.from_file(JSON)
TEXT = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\ta.'▁é \u0085<|>s"))) | st.lists(
    st.sampled_from(["the", " ", "  ", "\n", "don't", "12", "<|endoftext|>", "<s>", "über", "中", "word"])
).map("".join)


def test_proven_words_are_one_token():
    proven = prove_shortcut(MODEL)
    assert len(proven) > 5000
    some = sorted(proven)[::97]
    assert [len(x) for x in SP.encode(some)] == [1] * len(some)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(text):
    assert Counter(MODEL).counts([text]) == [len(SP.encode(text))]


def test_small_table_of_remembered_words():
    texts = [t for _, t, *_ in ODD if t]
    counter = Counter(MODEL, remembered=5)
    assert [n for t in texts for n in counter.counts([t])] == [len(x) for x in load(MODEL).encode(texts)]


def test_token_counts_of_odd_rows(spark):
    got = rows_of(token_counts(odd_table(spark), MODEL), "doc_id", "n_bytes", "n_tokens", "over_limit")
    n = [(r[0], len((r[1] or "").encode()), len(SP.encode(r[1] or ""))) for r in ODD]
    assert got == sorted([(*x, x[2] > 4096) for x in n], key=repr)
    assert any(x[3] for x in got)
    assert token_counts(empty_table(spark), MODEL).count() == 0


def test_token_counts_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op9_token_counts"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    assert all(r.n_tokens == len(SP.encode(docs[r.doc_id])) for r in got)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_fast_ids_equal_the_library(text):
    assert ENCODER.ids(text).tolist() == TOK.encode(text, add_special_tokens=False).ids


ENCODER = Encoder(*public_vocabulary())


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5000))
def test_cuts(n):
    parts = cuts(n)
    assert [a for a, _, _ in parts] == [sum(s for _, s, _ in parts[:k]) for k in range(len(parts))]
    assert sum(s for _, s, _ in parts) == n and len(parts) == -(-n // 1024)
    assert all(s == 1024 if k == 0 else 1024 / (k + 1) < s <= 1024 / k for _, s, k in parts)


def test_fewest_levels_that_fill_the_gaps():
    # 10 pieces of 600 tokens leave 424 each; a level holds 900 tokens in one document.
    sizes = {(16, 1): (10, 6000)} | {(k, 1): (1, 900) for k in range(16)} | {(k, -1): (1, 900) for k in range(16)}
    levels = filling_levels(sizes, 1024)
    gap = 10 * 424 + (16 - levels) * 124
    assert levels * 900 >= gap > (levels - 1) * 900 - 124


def check_packing(docs, pieces, copies=1, capacity=1024, padded=1):
    """Every id lies in one piece; sequences are gapless and but ``padded`` are full."""
    ids = {k: np.append(TOK.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4") for k, t in docs}
    held, laid, times = defaultdict(list), defaultdict(list), defaultdict(int)
    for p in pieces:
        assert p.length > 0 and p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        held[p.doc_id].append((p.start, p.length))
        laid[p.sequence_id].append((p.offset, p.length))
    for k, _ in docs:
        times[k] += 1
    assert held.keys() == times.keys()
    for k, parts in held.items():
        covered = np.zeros(len(ids[k]), int)
        for start, length in parts:
            covered[start : start + length] += 1
        assert (covered == times[k]).all()
    short = 0
    for parts in laid.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        short += at < capacity
    assert short <= padded
    assert sorted(laid) == list(range(len(laid)))


def test_packing_of_odd_rows(spark):
    df = odd_table(spark).filter("doc_id IS NOT NULL").repartition(4)
    check_packing([(r[0], r[1]) for r in ODD if r[0] is not None], pack(df, public_vocabulary()).collect(), padded=len(ODD))
    assert pack(odd_table(spark), public_vocabulary()).filter("doc_id IS NULL").count() > 0
    assert pack(empty_table(spark), public_vocabulary()).count() == 0


def test_round_trip_of_ids(spark):
    df = spark.createDataFrame([(1, "hello world " * 700), (2, "")], "doc_id long, text string")
    out = pack(df, public_vocabulary(), with_ids=True).orderBy("doc_id", "start").collect()
    ids = np.frombuffer(b"".join(p.ids for p in out if p.doc_id == 1), "<u4").tolist()
    assert TOK.decode(ids[:-1]) == "hello world " * 700 and ids[-1] == 0
    assert [p.ids for p in out if p.doc_id == 2] == [b"\0\0\0\0"]


def test_capacity_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        pack(odd_table(spark), public_vocabulary(), capacity=1000)


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    pieces = QUERIES["op6_packing"](spark, SF_SMALL).collect()
    check_packing(docs, pieces)
    # A document shorter than a sequence is one piece, but for those that fill gaps.
    least = sum(-(-p // 1024) for p in {p.doc_id: p.doc_tokens for p in pieces}.values())
    assert len(pieces) < 1.6 * least


def test_packing_over_many_tasks_and_lengths(spark):
    rng = random.Random(12)
    words = "the of and word token text some more house".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 30, 300, 700, 1500, 20_000 if k % 97 == 0 else 5])))) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    out = pack(df, public_vocabulary(), with_ids=True).collect()
    check_packing(rows, out)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in out)
    only = [(k, "word") for k in range(2100)]
    check_packing(only, pack(spark.createDataFrame(only, "doc_id long, text string"), public_vocabulary()).collect(), padded=2)
