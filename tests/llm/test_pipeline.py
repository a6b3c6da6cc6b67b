"""The pipeline against a plain version of each stage, and the optional import."""

import os
import re
import shutil
import subprocess
import sys
import tempfile

import corpus_pipeline
from conftest import SF_SMALL
from helpers import empty_table, odd_table
from test_near_suffix import plain_components
from test_sharding_mixing import check_mix
from test_tokens import check_packing

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def as_rows(df):
    return sorted(map(tuple, df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    quality, exact, near, mixing, packing = [f for _, f in corpus_pipeline.STAGES]

    before = as_rows(docs)
    good = quality(spark, docs, SF_SMALL)
    kept = as_rows(good)
    assert set(kept) < set(before)
    ids = {r[0] for r in kept}
    assert sum((k in ids) == bool(q) for k, q in labels.items()) > 0.95 * len(labels)

    good = spark.createDataFrame(kept, docs.schema)
    first = {}
    for r in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    once = as_rows(exact(spark, good, SF_SMALL))
    assert once == sorted(first.values(), key=repr)

    single = spark.createDataFrame(once, docs.schema)
    roots = {k for k, _, _, kept_ in plain_components([(r[0], r[1]) for r in once]) if kept_}
    lone = as_rows(near(spark, single, SF_SMALL))
    assert lone == [r for r in once if r[0] in roots]

    alone = spark.createDataFrame(lone, docs.schema)
    mixed = as_rows(mixing(spark, alone, SF_SMALL))
    assert set(mixed) <= set(lone)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in lone}
    from quarry.llm.mixing import mix

    rows = mix(alone).collect()
    check_mix(rows, {r[0]: (r[1], r[3]) for r in lone})
    taken = {r.doc_id: r.taken for r in rows}
    assert all(taken[k] == size[k] * sum(r[0] == k for r in mixed) for k in size)

    pieces = packing(spark, spark.createDataFrame(mixed, docs.schema), SF_SMALL).collect()
    check_packing([(r[0], r[1]) for r in mixed], pieces)

    # Which documents fill gaps depends on the tasks; what is packed does not.
    check_packing([(r[0], r[1]) for r in mixed], entry.queries()["pipeline"](spark, SF_SMALL).collect())


def test_odd_rows_pass_every_stage(spark):
    for table in (odd_table(spark), empty_table(spark)):
        docs = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF_SMALL)
            if k < 4:
                assert docs.columns == corpus_pipeline.COLUMNS
        assert (docs.count() > 0) == (table.count() > 0)


def test_entry_works_without_these_folders():
    """On a copy of the code, as the driver does it."""
    copy = tempfile.mkdtemp(prefix="quarry-copy-")
    for name in ("__spark_entry__.py", "quarry"):
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, f"{copy}/{name}", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, copy)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op')], 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True).stdout
    n, rest = out.split(" ", 1)
    assert int(n) >= 48 and rest.strip() == "[] False"


def test_all_queries_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
    assert {"op8_exact_dedup", "op10_mixing", "op12_fill_in_middle"} <= entry.oracle_sql().keys()
