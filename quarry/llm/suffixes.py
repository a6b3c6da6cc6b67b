"""Operator 4: repeated passages by sparse suffix arrays.

A passage of ``least`` words that occurs in two documents holds, among its
first ``window`` places, one that has the smallest hash of the ``prefix`` words
from there on (a minimiser); the same words choose the same place in every
copy.  So only suffixes at minimisers are retained:

1. every distinct text gives its minimisers' prefix hashes.  They are sorted
   over the whole cluster by hash and text, and neighbours are compared: a
   suffix is kept if a neighbour from another text begins with the same
   ``prefix`` words.  The order has no ties, so a prefix held by very many
   texts spreads over many tasks;
2. kept suffixes are extended to the left to every start that they are the
   minimiser of, and to the right to ``least`` words.  Extensions that occur
   in another text as well are matches;
3. overlapping matches of a text are joined to its longest passages.

Copies of a whole text go through this once and share the result.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, check_integer_ids, scan, slices, text_of
from quarry.llm.minhash import mix, words
from quarry.llm.registry import llm_query
from quarry.operators.joins import bounded_broadcast
from quarry.session import materialize, scratch_folder

#: Least words of a repeated passage, words compared at a minimiser, and places a minimiser is chosen from.
LEAST, PREFIX = 50, 30
WINDOW = LEAST - PREFIX + 1
#: Texts up to which the set of those to be extended is broadcast (16 bytes each).
BROADCAST_TEXTS = 1_000_000
BASE = 0x5851F42D4C957F2D
BACK = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BACK):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return tuple(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    size = 1 << max(12, (n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def word_hashes(text: str) -> np.ndarray:
    split = text.encode().split()
    return np.fromiter(map(words().__getitem__, split), np.uint64, len(split))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on, from prefix sums."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """For each start of ``window`` places, the first place of the smallest hash."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.arange(len(seen)) + seen.argmin(axis=1)


def _retained(least: int, prefix: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keys, out = part.column(0).to_numpy(), []
                for text in part.column(1).to_pylist():
                    grams = gram_hashes(word_hashes(text), prefix)
                    out.append(np.unique(grams[minimisers(grams, least - prefix + 1)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(out).view(np.int64) if out else [], pa.int64()),
                        pa.array(np.repeat(keys, [len(x) for x in out]), pa.int64()),
                    ],
                    names=["_suffix", "_text_key"],
                )

    return run


def _with_equal_neighbour(batches):
    """Rows, sorted by suffix and text, whose neighbour of another text begins alike.

    The first and the last suffix of a task are kept without a look: the
    neighbour may lie in the next task, and the next step is exact anyway."""
    held = None  # the suffix that goes on, its texts so far in this stretch, and whether it is sure
    for batch in batches:
        if not batch.num_rows:
            continue
        suffix, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = np.zeros(len(suffix), bool)
        same = (suffix[1:] == suffix[:-1]) & (key[1:] != key[:-1])
        keep[1:] |= same
        keep[:-1] |= same
        # Stretches of one suffix: a member that differs from its neighbours only in
        # being a repeat of the same text follows the stretch.
        starts = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))
        keep = np.repeat(np.logical_or.reduceat(keep, starts), np.diff(np.append(starts, len(suffix))))
        keep |= suffix == suffix[-1]
        if held is None or held == suffix[0]:
            keep |= suffix == suffix[0]
        held = suffix[-1]
        kept = np.flatnonzero(keep)
        kept = kept[np.concatenate([[True], (suffix[kept][1:] != suffix[kept][:-1]) | (key[kept][1:] != key[kept][:-1])])] if len(kept) else kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(suffix[kept]), pa.array(key[kept])], names=["_suffix", "_text_key"]
        )


def _extended(least: int, prefix: int):
    word = re.compile(WORD)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 64):
                cols: list[list] = [[] for _ in range(7)]
                for rep, key, text, kept in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    hashes = word_hashes(text)
                    grams = gram_hashes(hashes, prefix)
                    chosen = minimisers(grams, least - prefix + 1)
                    mine = np.isin(grams[chosen], np.array(kept, np.int64).view(np.uint64))
                    at = np.flatnonzero(mine)
                    if not len(at):
                        continue
                    bounds = np.array([m.span() for m in word.finditer(text)])
                    long = gram_hashes(hashes, least)[at].view(np.int64)
                    # Neighbouring places of one gram (a word that is repeated on and on) are one row.
                    new = np.concatenate([[True], (long[1:] != long[:-1]) | (np.diff(at) != 1)])
                    first, last = at[new], at[np.concatenate([new[1:], [True]])]
                    own = np.full(len(first), rep), np.full(len(first), key)
                    chars = bounds[first, 0], bounds[last + least - 1, 1]
                    for col, values in zip(cols, (long[new], *own, first, last, *chars), strict=True):
                        col.append(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols],
                    names=["_gram", "_rep", "_text_key", "_word", "_to", "start", "end"],
                )

    return run


def _stage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder (smaller than a checkpoint: columns are compressed)."""
    path = f"{scratch_folder(df.sparkSession, 'stage')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, prefix: int = PREFIX
) -> DataFrame:
    """One row per document and longest repeated passage: id, ``start``, ``end``
    (code points, end exclusive), ``n_words``, ``first_doc_id``.

    A passage is a union of overlapping stretches of ``least`` words that occur
    in another document too; ``first_doc_id`` is the smallest id that shares a
    stretch of it, so the first occurrence is the row where both ids agree.
    Words are runs without white space and must be equal; the white space
    between them may differ.  Ids are integers (any other type raises); rows without id, null texts
    and texts of fewer words have no passages.  Rows that repeat an id and its
    text are one document, equal texts of different ids repeat each other.  An
    empty table gives an empty result.  Other columns are not read.
    """
    check_integer_ids(docs, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")
    )
    rows = rows.withColumn("_text_key", F.xxhash64("_text"))
    suffixes = _stage(
        rows.select("_text_key", "_text").mapInArrow(_retained(least, prefix), "_suffix long, _text_key long")
    )
    kept = (
        suffixes.repartitionByRange("_suffix", "_text_key")
        .sortWithinPartitions("_suffix", "_text_key")
        .mapInArrow(_with_equal_neighbour, "_suffix long, _text_key long")
        .groupBy("_text_key")
        .agg(F.collect_set("_suffix").alias("_kept"))  # as many as the text's minimisers at most
    )
    kept = materialize(kept)
    members = rows.select("_text_key", "_id").distinct()
    copies = materialize(
        members.groupBy("_text_key").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"))
    )
    wanted = copies.join(kept.select("_text_key"), "_text_key").select(
        F.col("_rep").alias("_id"), F.col("_text_key").alias("_key")
    )
    wanted = bounded_broadcast(materialize(wanted), BROADCAST_TEXTS)
    chosen = rows.join(wanted, "_id").filter("_text_key = _key").select("_id", "_text_key", "_text")
    grams = _stage(
        chosen.join(kept, "_text_key")
        .select("_id", "_text_key", "_text", "_kept")
        .mapInArrow(
            _extended(least, prefix),
            "_gram long, _rep long, _text_key long, _word long, _to long, start long, end long",
        )
    )
    shared = grams.groupBy("_gram").agg(F.min("_rep").alias("_first"), F.max("_rep").alias("_last"))
    # Materialized, so that the join reads plain exchanges and a gram of many texts can be split.
    shared = materialize(shared.filter("_first < _last").select("_gram", "_first"))
    hits = grams.join(shared, "_gram")

    in_text = Window.partitionBy("_text_key").orderBy("_word")
    reach = F.max("_to").over(in_text.rowsBetween(Window.unboundedPreceding, -1)) + least
    spans = (
        hits.withColumn("_new", F.when(F.col("_word") < reach, 0).otherwise(1))
        .withColumn("_span", F.sum("_new").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_text_key", "_span")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            (F.max("_to") - F.min("_word") + least).alias("n_words"), F.min("_first").alias("_first"),
        )
    )
    alone = copies.filter("_copies = 1").select("_text_key", F.col("_rep").alias("_id"))
    single = spans.join(alone, "_text_key").select("_id", "start", "end", "n_words", "_first")

    # Copies repeat each other from the first word to the last.
    copied = members.join(copies.filter("_copies > 1"), "_text_key").select("_id", "_text_key", "_rep")
    earliest = spans.groupBy("_text_key").agg(F.min("_first").alias("_first"))
    several = copies.filter("_copies > 1").select("_text_key")
    of_copies = rows.join(bounded_broadcast(several, BROADCAST_TEXTS), "_text_key", "left_semi")
    sizes = of_copies.filter(F.regexp_count("_text", F.lit(WORD)) >= least).select(
        "_id", "_text_key",
        F.length(F.regexp_extract("_text", r"^[\x20\x09-\x0D]*", 0)).cast("long").alias("start"),
        F.length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+$", "")).cast("long").alias("end"),
        F.regexp_count("_text", F.lit(WORD)).cast("long").alias("n_words"),
    ).distinct()
    whole = (
        sizes.join(copied, ["_id", "_text_key"])
        .join(earliest, "_text_key", "left")
        .select("_id", "start", "end", "n_words", F.least("_rep", "_first").alias("_first"))
    )
    return single.unionByName(whole).select(
        F.col("_id").cast(kind).alias(id_col), "start", "end", "n_words", F.col("_first").cast(kind).alias("first_doc_id")
    )


SQL = r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           string_split_regex(text, '[^\x20\x09-\x0D]+') AS gaps
    FROM documents WHERE text <> ''
), w AS (
    SELECT doc_id, unnest(range(1, len(words) + 1)) AS n, unnest(list_transform(words, lambda x: length(x))) AS len,
           unnest(list_transform(gaps[1:len(words)], lambda x: length(x))) AS gap
    FROM t
), p AS (SELECT doc_id, n, len, sum(gap + len) OVER (PARTITION BY doc_id ORDER BY n) AS past FROM w),
b AS (
    SELECT doc_id, n, past - len AS start, lead(past, 49) OVER (PARTITION BY doc_id ORDER BY n) AS "end" FROM p
), g AS (
    SELECT doc_id, unnest(range(1, len(words) - 48)) AS n, unnest(list_transform(range(1, len(words) - 48),
        lambda k: md5(array_to_string(words[k:k + 49], ' ')))) AS gram
    FROM t
), s AS (
    SELECT gram, min(doc_id) AS first_id FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)
), h AS (
    SELECT doc_id, n, start, "end", first_id,
           CASE WHEN n - lag(n) OVER (PARTITION BY doc_id ORDER BY n) < 50 THEN 0 ELSE 1 END AS fresh
    FROM g JOIN s USING (gram) JOIN b USING (doc_id, n)
), k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS span FROM h)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end",
       CAST(max(n) - min(n) + 50 AS BIGINT) AS n_words, min(first_id) AS first_doc_id
FROM k GROUP BY doc_id, span
"""


@llm_query("op4_suffix_dedup", SQL)
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across all whole ``documents``."""
    return repeated_passages(scan(spark, sf_dir).select("doc_id", "text"))
