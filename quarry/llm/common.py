"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.layout import spread
from quarry.sources.tables import table

#: White space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def scan(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table scan, spread over the cores when the file has fewer splits than cores."""
    return spread(table(spark, sf_dir, name))


def text_of(text_col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text_col), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where a column of ``df`` (in any case of letters) has one."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def check_integer_ids(df: DataFrame, id_col: str) -> None:
    """Raise, before any job, unless the ids are integers."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer column, not {kind}")


def slices(batch, rows: int = 256):
    """Zero-copy cuts of a record batch, to bound what a task holds as Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def runs(batches, keys: int):
    """Tables of the rows that agree in the first ``keys`` columns, from batches
    sorted by them; a run may span batches."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        if part.num_rows == 1:
            rest = part
            continue
        change = np.zeros(part.num_rows - 1, bool)
        for k in range(keys):
            col = part.column(k).combine_chunks()
            change |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        ends = (np.flatnonzero(change) + 1).tolist()
        at = 0
        for end in ends:
            yield part.slice(at, end - at)
            at = end
        rest = part.slice(at)
    if rest is not None:
        yield rest
