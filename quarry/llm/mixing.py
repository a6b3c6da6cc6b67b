"""Operator 10: mixing sources to target weights by Pareto order sampling.

A source's target divided by its size is the number of copies that each of its
documents should get on average.  The whole part of it is certain: every
document is taken that often.  The fraction is drawn, by samples of fixed size
with unequal probabilities:

1. a source's documents fall into classes of similar size (a quarter of a
   power of two).  From the largest class to the smallest each gets a number of
   documents ``n``, by rounding its share of the words still wanted; what the
   rounding leaves or overdraws goes on to the next class;
2. in a class of ``N`` documents a document's inclusion probability ``p`` is
   ``n / N``, tilted towards the larger ones in proportion to size (less where
   ``p`` would pass 1), so that the probabilities sum to ``n``;
3. documents are ranked by random odds over inclusion odds,
   ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of the id, and the ``n``
   smallest ranks are the sample.

No class is ever ordered as a whole: the ranks are dealt into ``CELLS`` cells,
the cells' counts (partial aggregation) show in which one the sample ends, and
only that cell's rows are ordered.  The outcome is one row per source and
class, by which each document's copies follow from its own columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, scan, text_of
from quarry.llm.registry import llm_query
from quarry.operators.joins import bounded_broadcast
from quarry.operators.ordinal import with_ordinal
from quarry.session import materialize

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
CELLS = 4096
#: The column of a document's words.
SIZE = "_size"
#: Rows up to which the tables of sources and of their classes are broadcast, some hundred bytes each.
BROADCAST_SOURCES = 50_000
BROADCAST_CLASSES = 200_000


def uniform(key: Column, seed: str) -> Column:
    """A number above 0 and below 1, fixed by key and seed (52 bits of MD5)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``_source, source_size`` with ``target``: all words shared by weight, up to the cap.

    Weights repeat over the sources in code point order, null last.  What a
    capped source can't take is shared among the others by weight, until none
    is above its cap; each round is one aggregate over the table of sources."""
    ranked = with_ordinal(sizes, [F.col("_source").isNull(), "_source"], name="_pos")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_pos") % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("_source", "source_size", weight.cast("long").alias("_w")))
    cap = F.col("source_size") * max_copies
    total, free = table.agg(F.sum("source_size"), F.sum("_w")).first()
    level, capped_before = (total / free if free else 0.0), 0
    while True:
        capped = cap <= F.lit(level) * F.col("_w")
        n, taken, left = table.agg(
            F.count(F.when(capped, 1)), F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("_w")))
        ).first()
        if n == capped_before or not left:
            break
        capped_before, level = n, (total - taken) / left
    return table.withColumn("target", F.when(capped, cap.cast("double")).otherwise(F.lit(level) * F.col("_w")))


def size_class() -> Column:
    """Four classes to each power of two: how many bits a size has, and its first three."""
    bits = f"length(bin({SIZE}))"
    return F.expr(f"CAST({bits} * 8 + CASE WHEN {bits} >= 3 THEN shiftright({SIZE}, {bits} - 3) ELSE {SIZE} END AS INT)")


def _with_class(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Null-safe join of the rows with their class's row."""
    keys = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c"))
    return rows.join(table.withColumnsRenamed({"_source": "_s", "_class": "_c"}), keys).drop("_s", "_c")


def probability() -> Column:
    """A document's inclusion probability in its class; the class's sum is ``_n``."""
    mean = F.col("_words") / F.col("_rows")
    share = F.col("_n") / F.col("_rows")
    # How far the largest document may lie above the mean before its probability passes 1.
    room = (1 - share) / share / (F.col("_largest") / mean - 1)
    tilt = F.when(F.col("_largest") > mean, F.least(F.lit(1.0), room)).otherwise(F.lit(0.0))
    return F.when(F.col("_n") > 0, share * (1 + tilt * (F.col(SIZE) / mean - 1))).otherwise(F.lit(0.0))


def _rank(seed: str) -> Column:
    """Random odds over inclusion odds; null where nothing is drawn."""
    u, p = uniform(F.col("_key"), seed), F.col("_p")
    drawn = (F.col("_n") > 0) & (F.col("_n") < F.col("_rows"))
    # Rounding may take the largest document of a class to 1.
    return F.when(drawn, (u / (1 - u)) / (F.least(p, F.lit(1 - 1e-12)) / (1 - F.least(p, F.lit(1 - 1e-12)))))


def _cell() -> Column:
    return F.floor(F.col("_q") / (F.col("_q") + 1) * CELLS).cast("int")


def sample_sizes(classes: DataFrame, plan: DataFrame) -> DataFrame:
    """``classes`` with ``_n``: documents to draw of each.

    A source's classes (some hundred at most) are walked from the largest to
    the smallest; ``left`` is what is wanted beyond the words of the classes
    before, as expected of their numbers."""
    listed = classes.groupBy("_source").agg(
        F.sort_array(F.collect_list(F.struct("_class", "_rows", "_words", "_largest")), asc=False).alias("_list")
    )
    start = F.struct(F.lit(0.0).alias("left"), F.array().cast("array<bigint>").alias("ns"))

    def step(acc, c):
        wanted = acc["left"] + F.col("_fraction") * c["_words"]
        mean = c["_words"] / c["_rows"]
        n = F.when(c["_words"] == 0, 0).otherwise(
            F.least(F.greatest(F.floor(wanted / mean + 0.5), F.lit(0)), c["_rows"])).cast("long")
        return F.struct((wanted - n * mean).alias("left"), F.concat(acc["ns"], F.array(n)).alias("ns"))

    numbered = _with_source(listed, plan.select("_source", "_fraction")).withColumn(
        "_ns", F.aggregate("_list", start, step)["ns"])
    each = numbered.select("_source", F.explode(F.arrays_zip("_list", "_ns")).alias("_e"))
    return each.select("_source", "_e._list.*", F.col("_e._ns").alias("_n"))


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Null-safe join of the rows with their source's row."""
    return rows.join(table.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")


def decisions(rows: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """One row per source and class that fixes each document's copies.

    ``rows`` has ``_key, _source, _size, _class``.  Columns: ``source_size,
    target, _whole`` (certain copies), the class's ``_rows, _words, _largest``
    and ``_n``, and its sample's end: all of the cells before ``_last_cell``
    and, in it, the ranks up to ``_last_q, _last_key``."""
    sizes = rows.groupBy("_source").agg(F.sum(SIZE).alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = source_targets(sizes, weights, max_copies).select(
        "_source", "source_size", "target", F.floor(ratio).cast("long").alias("_whole"),
        (ratio - F.floor(ratio)).alias("_fraction"),
    )
    plan = bounded_broadcast(materialize(plan), BROADCAST_SOURCES)
    classes = rows.groupBy("_source", "_class").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(SIZE).alias("_words"), F.max(SIZE).alias("_largest"))
    drawn = bounded_broadcast(materialize(sample_sizes(classes, plan)), BROADCAST_CLASSES)
    ends = _ends(ranked(rows, drawn, seed).filter("_q IS NOT NULL"))
    joined = _with_source(_beside(drawn, ends), plan)
    return bounded_broadcast(materialize(joined), BROADCAST_CLASSES)


def ranked(rows: DataFrame, table: DataFrame, seed: str) -> DataFrame:
    """Rows with their class's row, probability ``_p``, rank ``_q`` and the rank's cell."""
    known = _with_class(rows, table).withColumn("_p", probability())
    return known.withColumn("_q", _rank(seed)).withColumn("_cell", _cell())


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tables of classes side by side."""
    right = right.withColumnsRenamed({"_source": "_s", "_class": "_c"})
    keys = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c"))
    return left.join(right, keys, "left").drop("_s", "_c")


def _ends(rows: DataFrame) -> DataFrame:
    """Where each class's ``_n`` smallest ranks end."""
    of_class = Window.partitionBy("_source", "_class")
    upto = of_class.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        rows.groupBy("_source", "_class", "_cell", "_n")
        .agg(F.count(F.lit(1)).alias("_in_cell"))
        .withColumn("_upto", F.sum("_in_cell").over(upto))
    )
    crossing = (
        cells.filter("_upto > _n")
        .groupBy("_source", "_class")
        .agg(F.min(F.struct("_cell", (F.col("_upto") - F.col("_in_cell")).alias("_before"))).alias("_x"))
        .select("_source", "_class", F.col("_x._cell").alias("_last_cell"), F.col("_x._before").alias("_before"))
    )
    crossing = bounded_broadcast(materialize(crossing), BROADCAST_CLASSES)
    # Rows alike in rank and key (repeated rows) are taken together.
    peers = of_class.orderBy("_q", "_key").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        _with_class(rows, crossing)
        .filter("_cell = _last_cell")
        .withColumn("_sum", F.col("_before") + F.count(F.lit(1)).over(peers))
        .filter("_sum <= _n")
        .groupBy("_source", "_class")
        .agg(F.max(F.struct("_q", "_key")).alias("_l"))
        .select("_source", "_class", F.col("_l._q").alias("_last_q"), F.col("_l._key").alias("_last_key"))
    )
    return _beside(crossing.drop("_before"), last)


def _in_sample() -> Column:
    """Whether a document belongs to its class's sample."""
    cell, q, key = F.col("_cell"), F.col("_q"), F.col("_key")
    last = (q < F.col("_last_q")) | ((q == F.col("_last_q")) & (key <= F.col("_last_key")))
    inside = (cell < F.col("_last_cell")) | ((cell == F.col("_last_cell")) & F.coalesce(last, F.lit(False)))
    everyone = F.col("_n") >= F.col("_rows")
    return everyone | (q.isNotNull() & F.coalesce(inside, F.lit(True)))


def _copies() -> Column:
    return F.col("_whole") + _in_sample().cast("long")


def _keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> dict:
    return {
        "_key": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
        "_source": F.col(source_col),
        SIZE: F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"),
    }


def _classed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_class", size_class())


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = "mix",
) -> DataFrame:
    """One row per input row: id, ``size`` (words), ``source_size``, ``target``, ``taken``.

    Null counts as the empty text, a null source as a source of its own (the
    last), a null id as the id ``""``.  Reruns agree: randomness is a hash of
    id and seed.  Repeated rows (same id) share one rank and verdict.  Sources
    without words get a target of 0.  An empty table gives an empty result.
    Other columns are not read.
    """
    keyed = _keyed(docs, id_col, source_col, text_col)
    rows = materialize(_classed(docs.select(F.col(id_col).alias("_id"), *(c.alias(n) for n, c in keyed.items()))))
    ruled = ranked(rows, decisions(rows.drop("_id"), weights, max_copies, seed), seed)
    return ruled.select(
        F.col("_id").alias(id_col), F.col(SIZE).alias("size"), "source_size", "target", (_copies() * F.col(SIZE)).alias("taken")
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    max_copies: int = MAX_COPIES,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: ``docs`` with each row repeated as often as it is taken.

    All columns stay; cases are as in ``mix``.  Texts are not shuffled: a
    row's copies follow from its own columns and its source's decision."""
    keyed = _keyed(docs, id_col, source_col, text_col)
    rows = materialize(_classed(docs.select(*(c.alias(n) for n, c in keyed.items()))))
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *(c.alias(n) for n, c in keyed.items())
    )
    ruled = ranked(_classed(held), decisions(rows, weights, max_copies, seed), seed)
    return ruled.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), _copies().cast("int")))).select("_row.*")


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS k,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
               / 4503599627370496.0 AS u
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
    FROM d GROUP BY source
), a AS (SELECT sum(source_size)::BIGINT AS total FROM s),
lv(n, level) AS (
    SELECT 0::BIGINT, (SELECT total FROM a) / (SELECT sum(w) FROM s)::DOUBLE
    UNION ALL
    SELECT c.n, c.level FROM lv, LATERAL (
        SELECT count(*) FILTER (3 * source_size <= lv.level * w) AS n,
               ((SELECT total FROM a) - sum(3 * source_size) FILTER (3 * source_size <= lv.level * w))::DOUBLE
                   / (sum(w) FILTER (3 * source_size > lv.level * w))::DOUBLE AS level
        FROM s) c
    WHERE c.n > lv.n
), lev AS (SELECT level FROM lv ORDER BY n DESC LIMIT 1),
t AS (
    SELECT s.*, CASE WHEN 3 * source_size <= level * w THEN (3 * source_size)::DOUBLE ELSE level * w END AS target
    FROM s, lev
), r AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS f FROM t
), p AS (
    SELECT source, source_size, target, floor(f) AS whole, f - floor(f) AS fraction FROM r
), e AS (
    SELECT d.*, length(bin(size)) * 8 + CASE WHEN length(bin(size)) >= 3 THEN size >> (length(bin(size)) - 3) ELSE size END
               AS class
    FROM d
), k AS (
    SELECT source, class, count(*) AS n_rows, sum(size)::BIGINT AS words, max(size) AS largest,
           row_number() OVER (PARTITION BY source ORDER BY class DESC) AS i
    FROM e GROUP BY source, class
), w(source, i, residue, n) AS (
    SELECT source, 0::BIGINT, 0.0::DOUBLE, 0::BIGINT FROM p
    UNION ALL
    SELECT source, i, wanted - n * (words / n_rows), n FROM (
        SELECT *, CASE WHEN words = 0 THEN 0 ELSE
            CAST(least(greatest(floor(wanted / (words / n_rows) + 0.5), 0), n_rows) AS BIGINT) END AS n
        FROM (
            SELECT k.source, k.i, k.words, k.n_rows, w.residue + p.fraction * k.words AS wanted
            FROM w JOIN k ON k.source IS NOT DISTINCT FROM w.source AND k.i = w.i + 1
                   JOIN p ON p.source IS NOT DISTINCT FROM w.source))
), c AS (
    SELECT k.source, k.class, k.n_rows, k.words / k.n_rows AS mean, k.largest, w.n, w.n / k.n_rows AS share
    FROM k JOIN w ON w.source IS NOT DISTINCT FROM k.source AND w.i = k.i
), b AS (
    SELECT *, CASE WHEN largest > mean AND n > 0 THEN least(1.0, (1 - share) / share / (largest / mean - 1)) ELSE 0.0 END AS tilt
    FROM c
), q AS (
    SELECT e.doc_id, e.k, e.source, e.class, e.size, e.u, b.n, b.n_rows,
           least(b.share * (1 + b.tilt * (e.size / nullif(b.mean, 0) - 1)), 1 - 1e-12) AS p
    FROM e JOIN b ON b.source IS NOT DISTINCT FROM e.source AND b.class = e.class
), o AS (
    SELECT *, n >= n_rows OR (n > 0 AND row_number() OVER (
        PARTITION BY source, class ORDER BY CASE WHEN n > 0 AND n < n_rows THEN (u / (1 - u)) / (p / (1 - p)) END, k) <= n)
        AS chosen
    FROM q
)
SELECT o.doc_id, o.size, p.source_size, p.target, CAST((p.whole + o.chosen::INT) * o.size AS BIGINT) AS taken
FROM o JOIN p ON p.source IS NOT DISTINCT FROM o.source
"""


@llm_query("op10_mixing", SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` by source, weights 5, 2, 1."""
    return mix(scan(spark, sf_dir).select("doc_id", "source", "text"))
