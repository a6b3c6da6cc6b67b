"""Operator 6: harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class ``k`` has the lengths in
``(capacity / (k + 1), capacity / k]``, and each of its bins holds exactly ``k``
of them.  A document longer than the capacity gives whole sequences first; what
is left, or a shorter document, goes to its class uncut.  Workers number their
own pieces; one count per task and class makes those numbers global, and the
``r``-th piece of class ``k`` lies in the class's bin ``r // k``.

A bin of whole pieces has a gap, at most a ``k + 1``-th of the capacity for
full ones.  A share of the documents, drawn at random and no larger than the
gaps need, goes to no class but is cut to fill them: gaps and fillers are laid
end to end on one line of tokens, and each overlap is a piece.  Fillers beyond
the last gap fill sequences of their own, so only the last sequence is not
full - unless half of the documents is less than all gaps, as in tiny tables,
whose last bins stay padded.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm.common import scan, slices, text_of
from quarry.llm.registry import llm_query
from quarry.session import materialize

CAPACITY = 1024
#: The id that ends each document (fixed value).
END_ID = 0
#: Letters outside this range may be classed differently by the two libraries' Unicode tables.
UNUSUAL = re.compile("[^\x00-ӿ‐-‧€]")


class Encoder:
    """Token ids of texts, as ``tokenizers`` gives them for a byte-level vocabulary.

    ``ranks_path`` names the same vocabulary as merge ranks; its library gives
    the same ids several times faster.  Texts with a special token's string or
    with letters that the two might class differently go through
    ``tokenizers`` itself."""

    def __init__(self, path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        plain = self.fast and not (self.special and self.special.search(text))
        if plain and (text.isascii() or not UNUSUAL.search(text)):
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=4)
def encoder(path: str, ranks_path: str | None = None, pattern: str | None = None) -> Encoder:
    return Encoder(path, ranks_path, pattern)


#: Documents are drawn into so many levels; the first half of them may become fillers.
LEVELS, FILLING = 32, 16
#: Tokens of the line of gaps that are filled together.
CELL = 16_384
#: Class of whole sequences, and mark of rows that hold a possible filler.
WHOLE, FILLER = 0, -1


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """Pieces ``(start, length, class)`` of a document of ``n`` tokens that is no filler."""
    whole, rest = divmod(n, capacity)
    out = [(k * capacity, capacity, WHOLE) for k in range(whole)]
    return out + ([(whole * capacity, rest, capacity // rest)] if rest else [])


def level_of(task: int, row: int) -> int:
    return xxhash.xxh64_intdigest(f"{task}:{row}") % LEVELS


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, _task long, _sub long, _class long, _rank long, ids binary"


def _pieces(id_col: str, id_type: pa.DataType, capacity: int, vocabulary: tuple, with_ids: bool):
    """Pieces of all documents as if none were a filler, ranked by class and level, and
    the possible fillers whole, with the tokens of their level before them as rank."""
    names = [id_col, *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches):
        task, numbered, row = TaskContext.get().partitionId(), {}, 0
        ids_of = encoder(*vocabulary).ids
        for batch in batches:
            for part in slices(batch, 512):
                keys, rows = [], []

                def add(key, start, size, crc, total, sub, kind, bits, keys=keys, rows=rows):
                    rank = numbered.get((kind, sub), 0)
                    numbered[kind, sub] = rank + (size if kind == FILLER else 1)
                    rows.append((start, size, crc, total, task, sub, kind, rank, bits))
                    keys.append(key)

                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(ids_of(text), END_ID).astype("<u4")
                    raw, total = ids.tobytes(), len(ids)
                    sub = min(level_of(task, row), FILLING)
                    row += 1
                    for start, size, kind in cuts(total, capacity):
                        bits = raw[4 * start : 4 * (start + size)]
                        add(key, start, size, zlib.crc32(bits), total, sub, kind, bits if with_ids else None)
                    if sub < FILLING:
                        add(key, 0, total, 0, total, sub, FILLER, raw)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                arrays = [pa.array(keys, id_type), *(pa.array(c, pa.int64()) for c in cols[:8]), pa.array(cols[8], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def filling_levels(sizes: dict[tuple[int, int], tuple[int, int]], capacity: int) -> int:
    """How many levels must fill, from counts and tokens by (level, class): the fewest
    whose documents are no less than the gaps of the others."""
    for levels in range(FILLING + 1):
        filling = sum(tokens for (sub, kind), (_, tokens) in sizes.items() if kind == FILLER and sub < levels)
        if filling >= sum(gaps_of(totals_of(sizes, levels), capacity).values()):
            return levels
    return FILLING


def totals_of(sizes: dict[tuple[int, int], tuple[int, int]], levels: int) -> dict[int, tuple[int, int]]:
    """Counts and tokens by class of the documents that are no fillers."""
    out: dict[int, tuple[int, int]] = {}
    for (sub, kind), (n, tokens) in sizes.items():
        if kind != FILLER and sub >= levels:
            before = out.get(kind, (0, 0))
            out[kind] = before[0] + n, before[1] + tokens
    return out


def gaps_of(totals: dict[int, tuple[int, int]], capacity: int) -> dict[int, int]:
    return {k: -(-n // max(k, 1)) * capacity - tokens for k, (n, tokens) in totals.items()}


def _running(column: int, names: list[str]):
    """Rows with the sum of a column over the task's rows before, and the task."""

    def run(batches):
        task, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            values = batch.column(column).to_numpy(zero_copy_only=False)
            sums = before + np.cumsum(values) - values
            before += int(values.sum())
            extra = [pa.array(sums, pa.int64()), pa.array([task] * batch.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return run


def _placed_gaps(bins: DataFrame, capacity: int) -> DataFrame:
    """``sequence_id, _at, _gap, _line``: the free ends of the bins, and where on the line each begins."""
    gaps = bins.groupBy("sequence_id").agg(F.sum("length").alias("_at"))
    gaps = gaps.select("sequence_id", "_at", (F.lit(capacity) - F.col("_at")).alias("_gap")).filter("_gap > 0")
    names = ["sequence_id", "_at", "_gap", "_line", "_pid"]
    laid = materialize(
        gaps.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id")
        .mapInArrow(_running(2, names), ", ".join(f"{n} long" for n in names))
    )
    # One row per partition.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    firsts = laid.groupBy("_pid").agg(F.sum("_gap").alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return laid.join(F.broadcast(firsts), "_pid").select(
        "sequence_id", "_at", "_gap", (F.col("_line") + F.col("_first")).alias("_line"))


def _fill(fillers: DataFrame, gaps: DataFrame, id_col: str, total_gap: int, sequences: int, capacity: int) -> DataFrame:
    """Pieces of the fillers: overlaps with the gaps, and beyond them whole sequences.

    ``fillers`` have ``_own`` (their place on the line), ``doc_tokens`` and ``ids``."""
    end = F.col("_own") + F.col("doc_tokens")

    def cells(begin: Column, after: Column) -> Column:
        return F.explode(F.sequence(F.floor(begin / CELL), F.floor((after - 1) / CELL))).alias("_cell")

    upto = F.least(end, F.lit(total_gap))
    inside = fillers.filter(F.col("_own") < total_gap).select(id_col, "doc_tokens", "_own", "ids", upto.alias("_until"), cells(F.col("_own"), upto))
    low, high = F.greatest("_own", F.col("_cell") * CELL), F.least("_until", (F.col("_cell") + 1) * CELL)
    inside = inside.select(
        id_col, "doc_tokens", "_own", "_cell", low.alias("_blob"), high.alias("_until"),
        F.expr(f"substring(ids, CAST(4 * (greatest(_own, _cell * {CELL}) - _own) + 1 AS INT),"
               f" CAST(4 * (least(_until, (_cell + 1) * {CELL}) - greatest(_own, _cell * {CELL})) AS INT))").alias("ids"),
    )
    open_gaps = gaps.select("*", cells(F.col("_line"), F.col("_line") + F.col("_gap")))
    met = inside.join(open_gaps, "_cell").select(
        "*", F.greatest("_line", "_blob").alias("_low"), F.least(F.col("_line") + F.col("_gap"), "_until").alias("_high")
    ).filter("_low < _high")
    filled = met.select(
        *_piece(id_col), "sequence_id", (F.col("_at") + F.col("_low") - F.col("_line")).alias("offset"))

    beyond = fillers.filter(end > total_gap).select(
        id_col, "doc_tokens", "_own", "ids", F.col("_own").alias("_blob"), F.greatest("_own", F.lit(total_gap)).alias("_begin"), end.alias("_until"))
    over = beyond.select("*", F.explode(F.sequence(
        F.floor((F.col("_begin") - total_gap) / capacity), F.floor((F.col("_until") - 1 - total_gap) / capacity))).alias("_block"))
    first = F.lit(total_gap) + F.col("_block") * capacity
    over = over.select("*", F.greatest("_begin", first).alias("_low"), F.least("_until", first + capacity).alias("_high"))
    more = over.select(
        *_piece(id_col), (F.col("_block") + sequences).alias("sequence_id"), (F.col("_low") - first).alias("offset"))
    return filled.unionByName(more)


def _piece(id_col: str) -> list:
    """A filler's tokens from ``_low`` to ``_high`` on the line; its ``ids`` begin at ``_blob``."""
    bits = F.expr("substring(ids, CAST(4 * (_low - _blob) + 1 AS INT), CAST(4 * (_high - _low) AS INT))")
    return [
        id_col, (F.col("_low") - F.col("_own")).alias("start"), (F.col("_high") - F.col("_low")).alias("length"),
        F.crc32(bits).alias("ids_crc32"), "doc_tokens", bits.alias("ids"),
    ]


def pack(
    docs: DataFrame,
    vocabulary: tuple,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (and ``ids``, little-endian 32 bit, if asked).

    ``vocabulary`` is ``(path, ranks_path or None, pattern or None)``, read on
    every worker.  Null counts as the empty text, whose document is the end id
    alone.  Repeated rows are packed each.  A null id is kept.  An empty table
    gives no pieces.  ``capacity`` must be a power of two.  Other columns are
    not read.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    kind = docs.schema[id_col].dataType
    run = _pieces("_id", to_arrow_type(kind), capacity, vocabulary, with_ids)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    # Tokenized once: the counts below and the result read the pieces again.
    pieces = materialize(rows.mapInArrow(run, f"_id {kind.simpleString()}, {COLUMNS}"))

    counts = materialize(pieces.groupBy("_task", "_sub", "_class").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_tokens")))
    by_class = counts.groupBy("_sub", "_class").agg(F.sum("_n").alias("n"), F.sum("_tokens").alias("tokens"))
    sizes = {(r["_sub"], r["_class"]): (r["n"], r["tokens"]) for r in by_class.collect()}  # a row per class and level
    levels = filling_levels(sizes, capacity)
    totals = totals_of(sizes, levels)
    total_gap = sum(gaps_of(totals, capacity).values())
    first_bin, sequences = {}, 0
    for k in sorted(totals):
        first_bin[k] = sequences
        sequences += -(-totals[k][0] // max(k, 1))

    spark = docs.sparkSession
    bases = spark.createDataFrame(list(first_bin.items()), "_class long, _bin long")
    before = Window.partitionBy("_class").orderBy("_task", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.filter((F.col("_class") != FILLER) & (F.col("_sub") >= levels)).select(
        "_task", "_sub", "_class", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = pieces.join(firsts.join(F.broadcast(bases), "_class"), ["_task", "_sub", "_class"]).withColumn(
        "_r", F.col("_rank") + F.col("_first"))
    placed = placed.withColumn("sequence_id", F.col("_bin") + F.expr("_r div greatest(_class, 1)"))
    out = ["_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset"]
    whole = placed.filter(F.col("_class") == WHOLE).withColumn("offset", F.lit(0).cast("long")).select(*out)
    bins = placed.filter(F.col("_class") != WHOLE)
    in_bin = Window.partitionBy("sequence_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    shared = bins.withColumn("offset", F.sum("length").over(in_bin) - F.col("length")).select(*out)
    result = whole.unionByName(shared)
    if levels:
        line, at = {}, 0
        for sub in range(levels):
            line[sub] = at
            at += sizes.get((sub, FILLER), (0, 0))[1]
        starts = spark.createDataFrame(list(line.items()), "_sub long, _line long")
        of_level = Window.partitionBy("_sub").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
        own = counts.filter((F.col("_class") == FILLER) & (F.col("_sub") < levels)).select(
            "_task", "_sub", F.coalesce(F.sum("_tokens").over(of_level), F.lit(0)).alias("_first"))
        fillers = pieces.filter((F.col("_class") == FILLER) & (F.col("_sub") < levels)).join(
            own.join(F.broadcast(starts), "_sub"), ["_task", "_sub"])
        fillers = fillers.select("_id", "doc_tokens", "ids", (F.col("_line") + F.col("_first") + F.col("_rank")).alias("_own"))
        gaps = _placed_gaps(bins, capacity)
        result = result.unionByName(_fill(fillers, gaps, "_id", total_gap, sequences, capacity).select(*out))
    return result.select(F.col("_id").alias(id_col), *(c for c in out[1:] if c != "ids" or with_ids))


def public_vocabulary() -> tuple:
    """The 50k byte-level vocabulary, as file, as ranks and with its pre-token pattern."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


@llm_query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    return pack(scan(spark, sf_dir), public_vocabulary())
