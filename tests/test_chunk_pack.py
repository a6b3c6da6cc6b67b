"""Chunker and packer properties; ordinal invariance."""

import random

from pyspark.sql import functions as F

from quarry.operators import chunk as C
from quarry.operators import pack as P
from quarry.operators.dictionary import encode
from quarry.operators.ordinal import with_ordinal

from conftest import SF_MID, SF_SMALL


def test_split_text_small_cases():
    assert C.split_text("", 10, 2) == []
    # separator kept at the start of the next piece, pieces merged up to size
    assert [t for _, t in C.split_text("aaa. bbb. ccc", 9, 0, [". "])] == ["aaa. bbb", ". ccc"]
    # oversize piece with no separator left is emitted as is
    out = C.split_text("x" * 30, 10, 0, [". "])
    assert [t for _, t in out] == ["x" * 30]
    # default separators recurse down to characters
    out = C.split_text("abcdefghij" * 3, 10, 0)
    assert all(len(t) <= 10 for _, t in out)


def _check_chunks(pdf_docs, chunks, size, overlap, oversize_ok):
    texts = dict(zip(pdf_docs.doc_id, pdf_docs.text))
    for doc_id, g in chunks.groupby("doc_id"):
        g = g.sort_values("chunk_no")
        text = texts[doc_id]
        assert list(g.chunk_no) == list(range(len(g)))
        covered = [False] * len(text)
        prev_end = None
        for s, t in zip(g.start, g.text):
            assert text[s:s + len(t)] == t
            if not oversize_ok:
                assert len(t) <= size
            for i in range(s, s + len(t)):
                covered[i] = True
            if prev_end is not None:
                assert prev_end - s <= overlap
            prev_end = s + len(t)
        assert all(c or text[i].isspace() for i, c in enumerate(covered))


def test_recursive_chunks_properties(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    ch = C.chunk(docs, size=2000, overlap=100).toPandas()
    assert len(ch) == 1845
    _check_chunks(docs.toPandas(), ch, 2000, 100, oversize_ok=False)


def test_sentence_chunks_properties(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    ch = C.chunk(docs, size=1750, overlap=100, separators=C.SENTENCE_SEPARATORS).toPandas()
    assert len(ch) == 1879
    _check_chunks(docs.toPandas(), ch, 1750, 100, oversize_ok=True)


def test_packing_keeps_null_and_repeated_keys(spark):
    # Shuffled ids: each list's tokens are its own number, as often as it is long.
    lists = [(None, 5), (None, 3), (1, 4), (2, 2), (2, 6), (2, 1), (2, 0), (3, 3)]
    rows = [(key, [n] * size) for n, (key, size) in enumerate(lists, 1)]
    df = spark.createDataFrame(rows, "k long, ids array<bigint>").repartition(3)
    got = P.pack(df, order_col="k", block=4, batch_rows=50).orderBy("block").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    flat = [t for _, ids in order for t in ids]
    assert [r.input_ids for r in got] == [flat[k : k + 4] for k in range(0, len(flat), 4)]


def plain_pack(rows, block, batch_rows):
    out = []
    for bi in range(0, len(rows), batch_rows):
        cat = sum(rows[bi:bi + batch_rows], [])
        total = len(cat) // block * block
        out += [(bi // batch_rows, j // block, cat[j:j + block]) for j in range(0, total, block)]
    return out


def test_pack_equals_plain_python(spark):
    rng = random.Random(7)
    rows = [[rng.randrange(1, 50) for _ in range(rng.randrange(0, 40))] for _ in range(257)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k long, ids array<bigint>")
    got = P.pack(df, order_col="k", ids_col="ids", block=16, batch_rows=50).collect()
    got = sorted((r.batch, r.block, list(r.input_ids)) for r in got)
    assert got == sorted(plain_pack(rows, 16, 50))
    assert all(r for _, _, r in got)


def test_ordinal_dense_and_partition_invariant(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id")
    a = with_ordinal(docs, ["doc_id"], num_partitions=3).toPandas().sort_values("pos")
    b = with_ordinal(docs.repartition(7), ["doc_id"], num_partitions=5).toPandas().sort_values("pos")
    assert list(a.pos) == list(range(len(a)))
    assert list(a.doc_id) == sorted(a.doc_id)
    assert list(a.doc_id) == list(b.doc_id)


def test_vocab_ranks_by_frequency(spark):
    docs = spark.createDataFrame([(1, "b a a"), (2, "c a b")], "doc_id long, text string")
    v = {r.word: r.id for r in P.build_vocab(docs).collect()}
    assert v == {"a": 1, "b": 2, "c": 3}
    ids = P.tokenize(docs, P.build_vocab(docs), key_cols=["doc_id"], text=F.col("text")).collect()
    assert {r.doc_id: list(r.ids) for r in ids} == {1: [2, 1, 1], 2: [3, 1, 2]}


def test_chunk_sql_states_the_splitter():
    import duckdb

    from quarry.plans.training import sql_chunks

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    for size, seps in ((300, C.DEFAULT_SEPARATORS), (180, C.SENTENCE_SEPARATORS)):
        sql = sql_chunks(size, 40, seps) + " SELECT doc_id, chunk_no, start, text FROM chunks"
        want = [(d, i, s, x) for d, t in docs for i, (s, x) in enumerate(C.split_text(t, size, 40, seps))]
        assert sorted(con.execute(sql).fetchall()) == sorted(want)


def test_chunks_of_titled_pages_carry_their_source(spark):
    df = spark.createDataFrame([("A", "s1", "x " * 50), ("B", None, None)], "title string, source string, text string")
    out = C.chunk(df, size=30, overlap=5, doc_col="title", carry=("source",))
    assert out.columns == ["title", "source", "chunk_no", "start", "text"]
    rows = out.collect()
    assert {(r.title, r.source) for r in rows} == {("A", "s1")} and len(rows) > 3


def test_long_text_without_separators_is_linear():
    import time

    t = time.time()
    assert len(C.split_text("x" * 400_000, 2000, 100)) == 211
    assert time.time() - t < 20


def test_pack_carries_masks_and_shards(spark):
    rows = [(k, [k * 10 + j for j in range(k % 5)], [1] * (k % 5)) for k in range(47)]
    df = spark.createDataFrame(rows, "k long, ids array<long>, m array<int>").repartition(4)
    for shards in (1, 3, 5):
        got = P.pack(df, order_col="k", block=7, batch_rows=6, num_shards=shards, more_cols=("m",)).collect()
        small, extra = divmod(47, shards)
        want, at = [], 0
        for s in range(shards):
            n = small + (s < extra)
            part = rows[at : at + n]
            at += n
            for b in range(0, n, 6):
                flat = [x for r in part[b : b + 6] for x in r[1]]
                want += [(s, b // 6, i // 7, flat[i : i + 7]) for i in range(0, len(flat) // 7 * 7, 7)]
        assert sorted((r.shard, r.batch, r.block, r.input_ids) for r in got) == sorted(want)
        assert all(r.labels == r.input_ids and r.m == [1] * 7 for r in got)


def test_padding_is_cut_to_the_maximum(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4],)], "ids array<long>")
    got = [tuple(map(tuple, r)) for r in df.select(*P.pad_left(F.col("ids"), 3, max_length=2)).collect()]
    assert got == [((1, 2), (1, 1)), ((0, 4), (0, 1))]


def test_blocks_across_many_partitions(spark):
    rng = random.Random(3)
    rows = [[rng.randrange(1, 9) for _ in range(rng.choice([0, 1, 3, 50]))] for _ in range(120)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k long, ids array<bigint>").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in (1, 7, 60):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            for block, batch_rows in ((16, 50), (400, 120), (5, 3)):
                got = P.pack(df, order_col="k", block=block, batch_rows=batch_rows).collect()
                assert sorted((r.batch, r.block, list(r.input_ids)) for r in got) == sorted(plain_pack(rows, block, batch_rows))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pack_of_no_rows_and_null_lists(spark):
    df = spark.createDataFrame([(1, None), (2, [1, 2, 3]), (None, [4])], "k long, ids array<bigint>")
    assert [r.input_ids for r in P.pack(df, order_col="k", block=2).orderBy("block").collect()] == [[4, 1], [2, 3]]
    assert P.pack(df.limit(0), order_col="k", block=2).count() == 0


def test_packing_joins_no_arrays_by_key(spark):
    df = spark.createDataFrame([(k, [k] * 9) for k in range(50)], "k long, ids array<bigint>")
    plan = P.pack(df, order_col="k", block=4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "MapInArrow" in plan


def test_encoding_by_task_equals_the_sent_vocabulary(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)] + ["é", "中", "\U0001f600", "a\tb"]
    rows = [(k, [rng.choice(words) for _ in range(rng.randrange(60))]) for k in range(500)] + [(500, None), (501, [])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>").repartition(5)
    known = {w: i for i, w in enumerate(words[::2], 1)}
    vocab = spark.createDataFrame(list(known.items()), "word string, id long")
    want = [(k, [known.get(w) for w in t or []]) for k, t in rows]
    for bound in (10_000, 0):
        out = encode(df, F.col("tokens"), vocab, sent_words=bound)
        assert out.columns == ["k", "tokens", "ids"]
        assert sorted((r.k, list(r.ids)) for r in out.collect()) == want
    assert encode(df.limit(0), F.col("tokens"), vocab, sent_words=0).count() == 0
    texts = df.select("k", F.array_join("tokens", " ").alias("text"))
    for bound in (10_000, 0):
        got = {r.k: list(r.ids) for r in encode(texts, F.col("text"), vocab, sent_words=bound).collect()}
        assert got == {k: [known.get(w) for w in " ".join(t or []).split()] for k, t in rows}
    assert encode(df, F.col("tokens"), vocab.limit(0)).filter(F.exists("ids", lambda x: x.isNotNull())).count() == 0
