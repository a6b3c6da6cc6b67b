"""Operator 5: near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

1. A document's set is its distinct shingles of five words.  Documents of equal
   sets form a class and go on as one row.
2. A class has ``CHUNKS * WIDTH`` b-bit minima.  The signature is split into
   ``CHUNKS`` chunks; of each chunk one symbol may be wrong, so one key is made
   for each symbol left out.  By the pigeonhole principle every pair of
   signatures that differ in fewer than ``2 * CHUNKS`` places shares a key.  A
   pair of similarity 0.75 shares none with a probability of about 1e-6.
3. Within a key, classes whose signatures differ in at most ``NEAR`` places are
   joined into families, of which only star edges leave the task.  Keys of very
   many classes are cut into blocks, and each two blocks meet in a task of
   their own.
4. Families meet with their full sets, again in blocks by size, and are searched
   breadth first: a class that was reached is not compared again.  Only exact
   links count: ``100 * intersection >= 75 * union``.
5. Components of the links are found by joins.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import check_integer_ids, free_names, runs, scan, slices, text_of
from quarry.llm.components import components
from quarry.llm.exact_dedup import one_of_each, text_digest
from quarry.llm.registry import llm_query
from quarry.operators.joins import bounded_broadcast
from quarry.operators.ordinal import with_ordinal
from quarry.session import materialize

SHINGLE = 5
#: Least similarity of a link, in hundredths.
PERCENT = 75
CHUNKS, WIDTH, BITS = 14, 5, 16
#: Signature distance up to which classes are compared in full.  At similarity
#: 0.75 the mean is 17.5 of 70 and the deviation 3.6.
NEAR = 38
#: Classes of a key, and shingles of a family, that one task holds at most (of each of two blocks).
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 2_000_000
#: Ids up to which the set of documents to be compared is broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Words whose hash a worker remembers at most.
REMEMBERED = 500_000

_draw = np.random.default_rng(5)
PLACE = _draw.integers(1, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)
SCALE = (_draw.integers(1, 1 << 32, CHUNKS * WIDTH, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
SHIFT = _draw.integers(0, 1 << 32, CHUNKS * WIDTH, np.uint64).astype(np.uint32)[:, None]


class Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@functools.cache
def words() -> Words:
    return Words()


def mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    A to Z are lower-cased; words are runs without ASCII white space.  A text
    of fewer words is one shingle, a text without words has none."""
    split = text.encode().lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words().__getitem__, split), np.uint64, len(split))
    if len(h) < n:
        return mix((h * PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    out = h[: len(h) - n + 1] * PLACE[0]
    for k in range(1, n):
        out += h[k : len(h) - n + 1 + k] * PLACE[k]
    return np.unique(mix(out))


def signature(hashes: np.ndarray) -> bytes:
    """The low ``BITS`` bits of the minimum of each hash function."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(SCALE), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(least, (SCALE * short[None, at : at + 4096] + SHIFT).min(axis=1), out=least)
    return least.astype("<u2").tobytes()


def digest(hashes: bytes) -> bytes:
    return hashlib.blake2b(hashes, digest_size=16).digest()


def _signatures(id_col: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary()),
                    ],
                    names=[id_col, "n_shingles", "_set", "_sig"],
                )

    return run


def _star(cluster: np.ndarray, ids: np.ndarray, out: list) -> None:
    """Edges from the members of a cluster to its smallest id."""
    if len(cluster) > 1:
        own = ids[cluster]
        root = own.min()
        out += [(int(x), int(root)) for x in own if x != root]


def reached(n: int, neighbours) -> list[np.ndarray]:
    """Connected clusters of ``n`` rows; ``neighbours(p, open)`` tells which of the
    rows ``open`` are linked with row ``p``.  Rows are asked for once each, and
    only against rows not reached before."""
    left, clusters = np.arange(n), []
    while len(left):
        queue, members, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            hit = neighbours(queue.pop(), left)
            members += list(left[hit])
            queue += list(left[hit])
            left = left[~hit]
        clusters.append(np.array(members))
    return clusters


def _edges(out: list):
    cols = list(zip(*out, strict=True)) or [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v"])


def _near_signatures(batches):
    """Star edges of the signature clusters of each key (and pair of blocks)."""
    out: list = []
    for group in runs(batches, 2):
        ids = group.column("id").to_numpy()
        sigs = np.frombuffer(b"".join(group.column("_sig").to_pylist()), "<u2").reshape(len(ids), -1)
        for cluster in reached(len(ids), lambda p, left, s=sigs: (s[left] != s[p]).sum(axis=1) <= NEAR):
            _star(cluster, ids, out)
        if len(out) > 10_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def linked(sets: list[np.ndarray], percent: int):
    """``neighbours`` by exact set similarity."""
    sizes = np.array([len(s) for s in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(place, np.cumsum(sizes)[:-1])
    mark = np.zeros(place.max() + 1, bool)

    def neighbours(p: int, left: np.ndarray) -> np.ndarray:
        # The smaller of two similar sets has at least this share of the larger.
        fit = 100 * np.minimum(sizes[left], sizes[p]) >= percent * np.maximum(sizes[left], sizes[p])
        hit = np.zeros(len(left), bool)
        mark[parts[p]] = True
        for k in np.flatnonzero(fit):
            both = np.count_nonzero(mark[parts[left[k]]])
            hit[k] = 100 * both >= percent * (sizes[p] + sizes[left[k]] - both)
        mark[parts[p]] = False
        return hit

    return neighbours


def _exact_links(percent: int):
    def run(batches):
        out: list = []
        for group in runs(batches, 2):
            ids = group.column("id").to_numpy()
            sets = [np.frombuffer(b, np.uint64) for b in group.column("_hashes").to_pylist()]
            if len(ids) > 1:
                for cluster in reached(len(ids), linked(sets, percent)):
                    _star(cluster, ids, out)
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _sets(batches):
    for batch in batches:
        for part in slices(batch):
            sets = [shingles(t).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(digest, sets), pa.binary()), pa.array(sets, pa.binary())],
                names=["id", "_set", "_hashes"],
            )


def in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """``rows`` with ``_meet``: a row of a key cut into ``blocks`` blocks appears
    once for each pair of blocks that its own is part of."""
    n, own = F.col(blocks), F.pmod(F.xxhash64("id"), F.col(blocks))
    meets = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.least(own, k) * n + F.greatest(own, k)
    )
    return rows.withColumn("_meet", F.explode(F.when(n > 1, meets).otherwise(F.array(F.lit(0).cast("long"))))).drop(blocks)


def families(classes: DataFrame) -> DataFrame:
    """``node, component`` of the classes ``id, _sig`` that have a near signature."""
    step, keys = 2 * WIDTH, CHUNKS * WIDTH

    def masked(k):
        chunk, symbol = F.floor(k / WIDTH).cast("int"), F.pmod(k, F.lit(WIDTH))
        start = chunk * step + 1
        return F.xxhash64(
            k,
            F.substring("_sig", start, symbol * 2),
            F.substring("_sig", start + symbol * 2 + 2, F.lit(step - 2) - symbol * 2),
        )

    held = classes.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(keys - 1)), masked)).alias("_key"))
    shared = held.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Materialized, so that the join below reads plain exchanges and a key of many classes can be split.
    shared = materialize(shared.select("_key", F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("_blocks")))
    rows = in_blocks(held.join(shared, "_key"), "_key", "_blocks")
    rows = rows.join(classes.select("id", "_sig"), "id").select("_key", "_meet", "id", "_sig")
    edges = (
        rows.repartition("_key", "_meet").sortWithinPartitions("_key", "_meet").mapInArrow(_near_signatures, "u long, v long")
    )
    return components(edges)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Ids are integers (any other type raises before a job).  Null counts as the empty text; a text without words has
    an empty set and is linked with nothing.  Equal sets are linked, whatever
    the texts.  Rows of the same id are one node, so they share
    their component.  A row without
    id is compared with nothing: its component is null and it is kept.  An
    empty table gives an empty result.  Other columns are not read.
    """
    check_integer_ids(docs, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("_text"))
    rows = materialize(texts.mapInArrow(_signatures(id_col), f"{id_col} {kind}, n_shingles long, _set binary, _sig binary"))
    some = rows.filter((F.col("n_shingles") > 0) & F.col(id_col).isNotNull())
    # Copies are one row per task before the shuffle.  Equal sets have equal signatures.
    classes = materialize(
        some.groupBy("_set", "_sig", "n_shingles").agg(F.min(id_col).cast("long").alias("id"))
    )
    family = materialize(families(classes))
    sized = family.join(classes.select("id", "_set", "n_shingles"), F.col("node") == F.col("id"))
    blocks = sized.groupBy("component").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("long").alias("_blocks"))
    members = in_blocks(sized.join(blocks, "component").select("component", "id", "_set", "_blocks"), "component", "_blocks")

    # Only the texts of classes with a near signature move.
    wanted = bounded_broadcast(family.select(F.col("node").alias("_wanted")), BROADCAST_IDS)
    near = texts.join(wanted, F.col(id_col).cast("long") == F.col("_wanted"), "left_semi")
    sets = near.select(F.col(id_col).cast("long").alias("id"), "_text").mapInArrow(
        _sets, "id long, _set binary, _hashes binary"
    )
    meeting = members.join(sets, ["id", "_set"]).select("component", "_meet", "id", "_hashes")
    links = (
        meeting.repartition("component", "_meet")
        .sortWithinPartitions("component", "_meet", "id")
        .mapInArrow(_exact_links(percent), "u long, v long")
    )
    found = components(links)
    named = (
        classes.join(found, F.col("id") == F.col("node"), "left")
        .select(F.col("_set").alias("_class"), F.coalesce("component", "id").alias("component_id"))
    )
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", id_col)).otherwise(F.col(id_col)).cast(kind)
    joined = some.join(named, F.col("_set") == F.col("_class")).select(id_col, "n_shingles", own.alias("component_id"))
    alone = rows.filter((F.col("n_shingles") == 0) | F.col(id_col).isNull()).select(
        id_col, "n_shingles", F.col(id_col).alias("component_id")
    )
    return joined.unionByName(alone).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


#: Ids above this leave no room for those of rows without id; they are numbered anew.
HIGHEST_ID = 1 << 62


def with_surrogates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _text, _row`` of ``docs``: rows without id get ids above all others, in the
    order of their texts' digests, and of those with equal texts one stays.

    Ids so high that none are left above them are replaced by their places in
    the order of all ids."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), row)
    nameless = rows.filter("_id IS NULL").withColumn("_digest", text_digest("_text"))
    numbered = with_ordinal(nameless.select("_digest").distinct(), ["_digest"], name="_pos")
    known = rows.filter("_id IS NOT NULL")
    top = known.agg(F.max("_id")).first()[0] or 0
    if top > HIGHEST_ID:
        places = materialize(with_ordinal(known.select("_id").distinct(), ["_id"], name="_pos"))
        known = known.join(places, "_id").select(F.col("_pos").alias("_id"), "_text", "_row")
        top = places.count()
    numbered = numbered.select("_digest", (F.col("_pos") + F.lit(top) + 1).alias("_id"))
    once = one_of_each(nameless.select("_digest", "_row"), ["_digest"], "_row")
    once = once.join(bounded_broadcast(numbered, BROADCAST_IDS), "_digest")
    named = once.select("_id", F.col("_row").getField(text_col).alias("_text"), "_row")
    return known.select("_id", "_text", "_row").unionByName(named)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest id) of each component; all columns stay.

    Ids are integers (any other type raises before a job).  Rows without id
    take part and come after all ids; a component of such rows alone keeps the
    one whose text has the smallest digest.  Columns of any names may stand
    beside the two."""
    check_integer_ids(docs, id_col)
    if not docs.filter(F.col(id_col).isNull()).isEmpty():
        rows = with_surrogates(docs, id_col, text_col)
        return drop_near_duplicates(rows, "_id", "_text").select("_row.*")
    (name,) = free_names(docs, "_gone")
    gone = near_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    gone = bounded_broadcast(materialize(gone), BROADCAST_IDS)
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')) END) AS shingle
    FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
    WHERE 100 * shared >= 75 * (p.n + q.n - shared)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, root) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node
), m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@llm_query("op5_near_dedup", SQL)
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all whole texts of ``documents``."""
    return near_duplicates(scan(spark, sf_dir).select("doc_id", "text"))
