"""Operator 2: document fingerprints by context-triggered piecewise hashing.

A rolling hash over ``WINDOW`` bytes ends a chunk wherever its value falls in
one residue class of the block size, so an edit moves the boundaries near it
only.  A fingerprint is ``block size:signature:signature at twice that size``,
with two characters per chunk.  The block size follows from the length alone
(32 to 64 blocks, and somewhat fewer chunks, as boundaries that crowd are
thinned where they lie); fingerprints are comparable when their block sizes
are equal or one is twice the other, and their likeness is one minus the edit
distance (insertions and deletions) over the sum of the signature lengths.

``fingerprint_neighbours`` also needs each document's successor.  It lays the
documents out by id in buckets that a sketch of the ids bounds, and sends each
bucket's first document to the bucket before as well: the texts move once.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import scan, slices, text_of
from quarry.llm.registry import llm_query

WINDOW = 7
LEAST_BLOCK = 3
CHUNKS = 64
#: Chunks in a signature at most (see ``thinned``).
MOST_CHUNKS = 2 * CHUNKS
#: Boundaries that may follow each other closely; beyond them the spacing is bounded.
BURST = 8
#: Longest chunk, in block sizes.
LONGEST = 4
#: Bytes hashed at once, so that a very long text needs no arrays of its own length.
STRETCH = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SYMBOLS = [a + b for a in ALPHABET for b in ALPHABET]
#: One odd multiplier per place in the window, and one to mix the sum.
FACTORS = [np.uint32(int.from_bytes(hashlib.md5(b"place %d" % k).digest()[:4], "big") | 1) for k in range(WINDOW)]
MIX = np.uint32(0x9E3779B1)


def block_size(n: int) -> int:
    size = LEAST_BLOCK
    while size * CHUNKS < n:
        size *= 2
    return size


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes at each place (fewer at the start)."""
    x = data.astype(np.uint32) + np.uint32(1)
    h = x * FACTORS[0]
    for k in range(1, min(WINDOW, len(x))):
        h[k:] += x[:-k] * FACTORS[k]
    h ^= h >> np.uint32(15)
    h *= MIX
    return h ^ (h >> np.uint32(13))


def boundaries(raw: bytes, size: int) -> tuple[list[int], list[int]]:
    """Ends of the chunks (exclusive) at block sizes ``size`` and ``2 * size``."""
    fine, coarse = [], []
    for at in range(0, len(raw), STRETCH):
        lead = min(at, WINDOW - 1)
        h = rolling(np.frombuffer(raw, np.uint8, min(STRETCH, len(raw) - at) + lead, at - lead))[lead:]
        ends = np.flatnonzero(h % np.uint32(size) == size - 1)
        fine += (ends + (at + 1)).tolist()
        coarse += (ends[h[ends] % np.uint32(2 * size) == 2 * size - 1] + (at + 1)).tolist()
    return fine, coarse


def thinned(raw: bytes, ends: list[int], size: int) -> list[int]:
    """``ends`` without those that crowd: no ``BURST + 1`` of them lie closer together
    than they could all through a text of ``CHUNKS`` blocks, so text that repeats a short
    piece with a boundary is covered evenly from end to end.

    Of crowded boundaries the one with the smallest window in half a block or so stays,
    and of equal windows as many as keep that distance.  It is the boundaries nearby that
    decide, not how many there are in all: what two texts share is cut alike."""
    apart = -(-BURST * CHUNKS * size // (MOST_CHUNKS - 2 * BURST))
    close = [k for k in range(len(ends) - BURST) if ends[k + BURST] - ends[k] < apart]
    if not close:
        return ends
    crowded = {k for first in close for k in range(first, first + BURST + 1)}
    windows = [raw[max(0, end - WINDOW) : end] for end in ends]

    def least(k: int) -> bool:
        for step in (-1, 1):
            at = k + step
            while 0 <= at < len(ends) and BURST * abs(ends[at] - ends[k]) < apart:
                if windows[at] < windows[k]:
                    return False
                at += step
        return True

    kept: list[int] = []
    for k, end in enumerate(ends):
        if k in crowded and (kept and BURST * (end - kept[-1]) < apart or not least(k)):
            continue
        if len(kept) < BURST or end - kept[-BURST] >= apart:
            kept.append(end)
    return kept


def signature(raw: bytes, ends: list[int], size: int) -> str:
    """Two characters for each chunk.  A chunk of more than ``LONGEST`` blocks (as in
    text that repeats itself without a boundary) is cut every so many bytes from its start."""
    cuts, at, longest = [], 0, LONGEST * size
    for end in [*(e for e in thinned(raw, ends, size) if e < len(raw)), len(raw)]:
        cuts += range(at + longest, end, longest)
        cuts.append(end)
        at = end
    out, at, view = [], 0, memoryview(raw)
    for end in cuts:
        out.append(SYMBOLS[zlib.crc32(view[at:end]) & 4095])
        at = end
    return "".join(out)


def fingerprint(text: str) -> str:
    raw = text.encode()
    size = block_size(len(raw))
    if not raw:
        return f"{size}::"
    fine, coarse = boundaries(raw, size)
    return f"{size}:{signature(raw, fine, size)}:{signature(raw, coarse, 2 * size)}"


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by one machine-word row per symbol."""
    where: dict[str, int] = {}
    for k, s in enumerate(a):
        where[s] = where.get(s, 0) | 1 << k
    every = (1 << len(a)) - 1
    row = every
    for s in b:
        hit = row & where.get(s, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def likeness(one: str, other: str) -> float:
    """0 to 1; 0 where block sizes are not compatible."""
    if one == other:
        return 1.0
    (n, fine, coarse), (m, fine2, coarse2) = one.split(":"), other.split(":")
    if n == m:
        a, b = fine, fine2
    elif int(n) == 2 * int(m):
        a, b = fine, coarse2
    elif int(m) == 2 * int(n):
        a, b = coarse, fine2
    else:
        return 0.0
    if not a or not b:
        return 0.0
    a, b = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (a, b))
    same = common_subsequence(a, b)
    distance = len(a) + len(b) - 2 * same
    return 1.0 - distance / (len(a) + len(b))


def edited(text: str, successor: str) -> str:
    """The last half of ``text`` replaced by as many first characters of ``successor``."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


def _bucket(edges: list[int]):
    bounds = np.array(edges, np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="right").astype(np.int32))

    return bucket


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_bucket, _extra, id, _text``, sorted in each partition so that a row is
    followed by its successor; ``_extra`` rows only end a bucket."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(least).cast("long"))
    # Ids only; several buckets to a partition even out what hashing them does not.
    ids = docs.select(key.alias("_key"))
    shares = [k / (4 * parts) for k in range(1, 4 * parts)]
    found = ids.agg(F.percentile_approx("_key", shares, max(10_000, 40 * parts)).alias("e")).first()["e"]
    bucket = _bucket(sorted(set(found or [])))
    heads = ids.groupBy(bucket("_key").alias("b")).agg(F.min("_key").alias("h")).orderBy("b").collect()
    before = [heads[k - 1]["b"] for k in range(len(heads))]  # the first goes to the last
    extras = spark.createDataFrame(
        [(r["h"], b) for r, b in zip(heads, before, strict=True)], "_head long, _before int"
    )
    rows = docs.select(
        F.col(id_col).alias(id_col), text_of(text_col).alias("_text"), key.alias("_key")
    ).withColumn("_own", bucket("_key"))
    # One head per bucket, so the broadcast has 4 rows a shuffle partition at most.
    rows = rows.join(F.broadcast(extras), F.col("_key") == F.col("_head"), "left")
    own = F.struct(F.col("_own").alias("_bucket"), F.lit(0).alias("_extra"))
    end = F.struct(F.col("_before").alias("_bucket"), F.lit(1).alias("_extra"))
    places = F.when(F.col("_head").isNull(), F.array(own)).otherwise(F.array(own, end))
    return (
        rows.withColumn("_place", F.explode(places))
        .select("_place._bucket", "_place._extra", "_key", id_col, "_text")
        .repartition(parts, "_bucket")
        .sortWithinPartitions("_bucket", "_extra", "_key", "_text")
        .select("_bucket", "_extra", id_col, "_text")
    )


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Successors go by ascending integer id, the last one's is the first; rows
    of equal id are ordered by text, null ids come first.  A table of one row
    is its own successor.  Null counts as the empty text (fingerprint of no
    chunks, likeness 0 to any other).  An empty table gives an empty result.
    Other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        held = None  # the row that waits for its successor: bucket, id, text, fingerprint
        for batch in batches:
            for part in slices(batch):
                out = []
                for b, extra, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if extra and held is None:
                        continue
                    own = fingerprint(text)
                    if held is not None and held[0] == b:
                        changed = edited(held[2], text)
                        print_ = fingerprint(changed)
                        out.append((
                            held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(),
                            held[3], print_, likeness(held[3], print_), likeness(held[3], own),
                        ))
                    held = None if extra else (b, key, text, own)
                cols = list(zip(*out, strict=True)) or [[]] * 7
                types = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                    names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_successors(docs, id_col, text_col).mapInArrow(
        run,
        f"{id_col} {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


@llm_query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents``, of its edited text, and their likeness."""
    return fingerprint_neighbours(scan(spark, sf_dir), "doc_id", "text")
