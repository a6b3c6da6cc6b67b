"""pack computes its rows once when it is given their keys."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import pack as P


def blocks(df):
    return sorted((r["shard"], r["batch"], r["block"], tuple(r["input_ids"]), tuple(r["labels"])) for r in df.collect())


def rows_of(spark, kind):
    rng = random.Random(3)
    keys = {"plain": list(range(500)), "twice": [i // 2 for i in range(500)], "nulls": [None if i % 3 else i for i in range(500)],
            "equal": [7] * 500, "few": [3, 1], "none": []}[kind]
    rows = [(k, [rng.randrange(9) for _ in range(rng.randrange(12))]) for k in rng.sample(keys, len(keys))]
    return spark.createDataFrame(rows, "k long, ids array<bigint>").repartition(5)


@pytest.mark.parametrize("kind", ["plain", "twice", "nulls", "equal", "few", "none"])
def test_blocks_are_those_without_keys(spark, kind):
    rows = rows_of(spark, kind)
    how = {"order_col": "k", "block": 16, "batch_rows": 90, "num_shards": 2}
    assert blocks(P.pack(rows, **how, keys=rows.select("k"))) == blocks(P.pack(rows, **how))


def test_rows_are_computed_once(spark, scratch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = rows_of(spark, "plain").select("k", "ids").cache()
    made = rows.mapInArrow(counted, "k bigint, ids array<bigint>")
    out = P.pack(made, order_col="k", block=16, batch_rows=90, keys=rows.select("k"))
    assert out.agg(F.count(F.lit(1))).first()[0] > 0
    # Before: 1000, a pass for the sample and one for the rows.
    assert seen.value == 500
