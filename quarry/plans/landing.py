"""File round trips (A1-A7, A10-A15) and nested records (B1, I1): a supplied
table is written in each format to the shared scratch folder, all rows, and
read back.  Texts are decorated with the delimiters, quotes, backslashes and
line ends that the format has to carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.layout import spread
from quarry.plans.registry import query
from quarry.session import scratch_folder
from quarry.sources import files
from quarry.sources.tables import table


def _odd_text() -> Column:
    """The text, with characters that file formats give a meaning to."""
    tail = F.lit(' , "q" \\ \\, \\\\ "" \n,end\\')
    return F.when(F.col("doc_id") % 5 == 0, F.concat("text", tail)).when(
        F.col("doc_id") % 5 == 1, F.concat(F.lit("\n\\\n"), "text")).otherwise(F.col("text"))


SQL_ODD = r"""odd AS (SELECT doc_id, lang, CASE
  WHEN doc_id % 5 = 0 THEN text || ' , "q" \ \, \\ "" ' || chr(10) || ',end\'
  WHEN doc_id % 5 = 1 THEN chr(10) || '\' || chr(10) || text ELSE text END AS text FROM documents)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", "lang", _odd_text().alias("text"))


MARKER = "<END>"


@query(
    "file_delimited",
    rf"""WITH {SQL_ODD}, r AS (
  SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE regexp_replace(
    CAST(doc_id AS VARCHAR) || ':' || text, '^\s+|\s+$', '', 'g') END AS record FROM odd)
SELECT md5(record) AS record_md5, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY record""",
)
def file_delimited(spark: SparkSession, d: str) -> DataFrame:
    """A10 + A1: records with line ends, some of them empty, between markers."""
    path = scratch_folder(spark, "delimited")
    record = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(
        F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text"))
    files.write_delimited(_docs(spark, d).select(record.alias("text")), path, MARKER)
    back = files.read_delimited(spark, path, MARKER, strip=True)
    return back.groupBy(F.md5("text").alias("record_md5")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "file_lines",
    r"SELECT md5(CAST(doc_id AS VARCHAR) || ' ' || replace(text, chr(10), ' ')) AS line_md5 FROM documents",
)
def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """A11 + A2: one record per line."""
    path = scratch_folder(spark, "lines")
    line = F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    files.write_lines(spread(table(spark, d, "documents")).select(line.alias("line")), path, "line")
    return files.read_lines(spark, path).select(F.md5("line").alias("line_md5"))


@query("file_csv", f"WITH {SQL_ODD} SELECT doc_id, lang, md5(text) AS text_md5 FROM odd")
def file_csv(spark: SparkSession, d: str) -> DataFrame:
    """A12 + A3: quoted CSV whose fields hold line ends, quotes and commas."""
    path = scratch_folder(spark, "csv")
    files.write_csv(_docs(spark, d), path)
    back = files.read_csv_multiline(spark, path, "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("file_escaped_csv", f"WITH {SQL_ODD} SELECT doc_id, lang, md5(text) AS text_md5 FROM odd")
def file_escaped_csv(spark: SparkSession, d: str) -> DataFrame:
    """A12 + A4: the same rows without quotes, escaped by backslashes."""
    path = scratch_folder(spark, "escaped")
    files.write_escaped_csv(_docs(spark, d), path)
    back = files.read_escaped_csv(spark, path, ["doc_id", "lang", "text"])
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5("text").alias("text_md5"))


@query("file_append", "SELECT doc_id, source, n_chars FROM documents")
def file_append(spark: SparkSession, d: str) -> DataFrame:
    """A table made by its first write and appended to, columns in another order."""
    path = scratch_folder(spark, "append")
    docs = table(spark, d, "documents")
    files.append_table(docs.filter("doc_id % 2 = 0").select("doc_id", "source", "n_chars"), path)
    files.append_table(docs.filter("doc_id % 2 != 0").select("n_chars", "doc_id", "source"), path)
    return spark.read.parquet(path).select("doc_id", "source", "n_chars")


@query(
    "file_transcripts",
    """SELECT CAST(conv_id AS VARCHAR) AS video,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seg_no, text
FROM conversations""",
)
def file_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """A5: JSON files of up to 50 conversations each, one row per segment back."""
    path = scratch_folder(spark, "transcripts")
    conv = table(spark, d, "conversations")
    turns = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")).select(
        F.expr("conv_id div 50").alias("file"), F.col("conv_id").cast("string").alias("video"),
        F.transform("t", lambda x: F.struct(x["text"].alias("text"))).alias("segs"))
    objects = turns.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("video", "segs"))).alias("m"))
    lines = objects.select("file", F.to_json("m").alias("value"))
    lines.write.partitionBy("file").text(path)
    return files.read_transcripts(spark, path)


@query(
    "file_answers",
    """WITH a AS (SELECT 'run' || CAST(conv_id // 20 AS VARCHAR) AS run, text, role,
    row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id, turn) - 1 AS pos FROM conversations)
SELECT run, CAST(pos AS INTEGER) AS pos, md5(text) AS answer_md5 FROM a""",
)
def file_answers(spark: SparkSession, d: str) -> DataFrame:
    """A JSON map of runs, each run's answers one string with end markers."""
    path = scratch_folder(spark, "answers")
    run = F.concat(F.lit("run"), F.expr("conv_id div 20").cast("string"))
    runs = table(spark, d, "conversations").groupBy(run.alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("conv_id", "turn", "text"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["text"], F.lit(MARKER))), "")
    objects = runs.select("run", F.to_json(F.create_map("run", whole)).alias("value"))
    objects.write.partitionBy("run").text(path)
    back = files.read_answer_archive(spark, path, MARKER)
    return back.select("run", "pos", F.md5("answer").alias("answer_md5"))


@query(
    "file_runs",
    """SELECT lang AS dataset, doc_id, CAST(doc_id % 3 AS VARCHAR) AS rank FROM documents
WHERE lang = 'en' AND doc_id % 3 = 1""",
)
def file_runs(spark: SparkSession, d: str) -> DataFrame:
    """Answers laid out by run; one run read back through its partitions."""
    path = scratch_folder(spark, "runs")
    rows = table(spark, d, "documents").filter("lang IS NOT NULL").select(
        F.col("lang").alias("dataset"), F.lit(False).alias("formatted"),
        F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("rank"),
        F.lit("greedy").alias("decoding"), F.lit("c561").alias("checkpoint"), "doc_id")
    files.write_runs(rows, path)
    back = spark.read.parquet(path).filter((F.col("dataset") == "en") & (F.col("rank") == "r1"))
    return back.select("dataset", "doc_id", F.substring("rank", 2, 9).alias("rank"))


@query("file_jsonl", f"WITH {SQL_ODD} SELECT doc_id, lang, md5(text) AS text_md5 FROM odd")
def file_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """One JSON object per line, whatever the text holds."""
    path = scratch_folder(spark, "jsonl")
    files.write_jsonl(_docs(spark, d), path)
    back = files.read_nested(spark, path, "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query(
    "nested_titles",
    """WITH t AS (SELECT conv_id, turn, unnest(['doc' || CAST(conv_id % 7 AS VARCHAR),
    'doc' || CAST(turn AS VARCHAR), 'doc' || CAST(conv_id % 7 AS VARCHAR)]) AS title
  FROM conversations WHERE role = 'user')
SELECT title, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT conv_id) AS BIGINT) AS n_questions FROM t GROUP BY title""",
)
def nested_titles(spark: SparkSession, d: str) -> DataFrame:
    """A7 + B1 + I1: nested question records written as JSON, of which only the
    titles of the contexts are projected, one row per occurrence."""
    path = scratch_folder(spark, "nested")
    q = table(spark, d, "conversations").filter("role = 'user'")
    a = F.concat(F.lit("doc"), (F.col("conv_id") % 7).cast("string"))
    b = F.concat(F.lit("doc"), F.col("turn").cast("string"))
    titles = F.struct(F.array(a, b, a).alias("title"), F.array(F.array("text")).alias("sentences"))
    files.write_jsonl(q.select("conv_id", F.col("text").alias("question"), titles.alias("context")), path)
    back = files.read_nested(
        spark, path, "conv_id long, context struct<title: array<string>, sentences: array<array<string>>>")
    pairs = back.select("conv_id", F.explode("context.title").alias("title"))
    return pairs.groupBy("title").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("n_questions"))


# ---- sections of pages (B8, D3) and batches of rows (B12) ----------------------


SQL_SECTIONS = """s AS (SELECT doc_id, t.n - 1 AS sec_no, t.x AS text,
    CASE (doc_id + t.n) % 4 WHEN 0 THEN 'References' WHEN 1 THEN 'External Links' ELSE 'Part' END AS sec_title
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(x, n))"""


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as sections, some titled as those that are dropped."""
    docs = spread(table(spark, d, "documents"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sec_no", "text"))
    kind = (F.col("doc_id") + F.col("sec_no") + 1) % 4
    title = F.when(kind == 0, "References").when(kind == 1, "External Links").otherwise("Part")
    return lines.withColumn("sec_title", title)


@query("section_filter", f"WITH {SQL_SECTIONS} SELECT doc_id, CAST(sec_no AS INTEGER) AS sec_no, "
       "text FROM s WHERE sec_title = 'Part'")
def section_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sections other than references and external links."""
    from quarry.operators.agg import drop_sections

    return drop_sections(sections(spark, d)).select("doc_id", "sec_no", "text")


@query(
    "page_assembly",
    f"""WITH {SQL_SECTIONS}
SELECT doc_id, coalesce(string_agg(text || chr(10), '' ORDER BY sec_no) FILTER (sec_title = 'Part'), '') AS text
FROM s GROUP BY doc_id""",
)
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    """D3: pages put together from their kept sections; a page without any is empty."""
    from quarry.operators.agg import page_text

    return page_text(sections(spark, d), key="doc_id").select("doc_id", "text")


@query(
    "row_batches",
    """WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 400 AS batch FROM documents)
SELECT CAST(batch AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_doc FROM p GROUP BY batch""",
)
def row_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 400 rows by document order."""
    from quarry.operators import ordinal

    rows = ordinal.with_ordinal(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return rows.groupBy(ordinal.batch_id().alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
