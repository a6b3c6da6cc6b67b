"""Corpus cleaning, filtering, sampling and coverage queries (documents,
benchmark, labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import joins, ordinal, sample
from quarry.operators.agg import value_counts
from quarry.operators.layout import spread
from quarry.plans import fixtures as fx
from quarry.plans.registry import query
from quarry.sources.tables import table

SQL_WORD_COUNT = "CAST(len(string_split(coalesce(CAST({c} AS VARCHAR), 'nan'), ' ')) AS BIGINT)"


@query(
    "word_count_filter",
    f"""SELECT doc_id, len_count FROM (
  SELECT doc_id, {SQL_WORD_COUNT.format(c='text')} AS len_count FROM documents)
WHERE len_count >= 100""",
)
def word_count_filter(spark: SparkSession, d: str) -> DataFrame:
    """Word count as a column, rows with at least 100 words."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.word_count("text").alias("len_count")).filter(
        F.col("len_count") >= 100
    )


SQL_WIKI_CLEAN = """regexp_replace(regexp_replace(replace(replace(replace(replace({c},
  '==REFERENCES==', ''), '== References ==', ''), '== Notes ==', ''),
  '== Notes and references ==', ''), 'ISBN.*', '', 'g'), '(https?:\\S+?)/.*', '', 'g')"""


@query(
    "wiki_clean",
    f"WITH {fx.SQL_WIKI}\nSELECT doc_id, {SQL_WIKI_CLEAN.format(c='text')} AS text FROM wiki",
)
def wiki_clean(spark: SparkSession, d: str) -> DataFrame:
    """H3: the six ordered deletions on page text."""
    return spread(fx.wiki_docs(spark, d)).select("doc_id", T.wiki_clean("text").alias("text"))


SQL_WORD_TOKENS = r"regexp_extract_all({c}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]', 0)"


@query(
    "vocab_filter",
    f"""WITH {fx.SQL_WIKI},
vocab AS (SELECT DISTINCT lower(w) AS w
          FROM (SELECT unnest({SQL_WORD_TOKENS.format(c='text')}) AS w FROM benchmark)),
toks AS (SELECT doc_id, t.tok, t.n
         FROM wiki, unnest({SQL_WORD_TOKENS.format(c=SQL_WIKI_CLEAN.format(c='text'))})
              WITH ORDINALITY AS t(tok, n)),
kept AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY n) AS text FROM toks
         WHERE lower(tok) IN (SELECT w FROM vocab) GROUP BY doc_id)
SELECT w.doc_id, coalesce(k.text, '') AS text FROM wiki w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
)
def vocab_filter(spark: SparkSession, d: str) -> DataFrame:
    """H3 -> H4 -> C5/H5/H6: cleaned page text reduced to dictionary words in
    order.  The dictionary is the lower-cased word set of ``benchmark``."""
    bench = table(spark, d, "benchmark")
    vocab = bench.select(F.explode(T.word_tokens("text")).alias("w")).select(
        F.lower("w").alias("word")
    )
    docs = spread(fx.wiki_docs(spark, d)).select("doc_id", T.wiki_clean("text").alias("clean"))
    return joins.dictionary_filter(docs, "doc_id", T.word_tokens("clean"), vocab)


@query(
    "value_counts_source",
    "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE source IS NOT NULL GROUP BY source",
)
def value_counts_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source, most frequent first."""
    return value_counts(table(spark, d, "documents"), "source")


@query(
    "dedupe_first",
    """SELECT doc_id, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""",
)
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """One document per distinct text, the first by ``doc_id``."""
    # Only digests move: a text is hashed where it is read.
    docs = table(spark, d, "documents").select(
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "doc_id", "n_chars")
    return joins.first_by_key(docs, "digest", "doc_id").select("doc_id", "n_chars")


SAMPLE_N = 5000
SEED = 42


@query(
    "seeded_sample",
    f"""SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || ':{SEED}') AS shuffle_key FROM documents
ORDER BY shuffle_key, doc_id LIMIT {SAMPLE_N}""",
)
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """F1 + F2: seeded shuffle, first 5000 (the sampling is the feature)."""
    docs = sample.seeded_shuffle(table(spark, d, "documents").select("doc_id"), "doc_id", SEED)
    return sample.first_by_hash(docs, SAMPLE_N, "shuffle_key", "doc_id")


SLICE = (100, 600)


@query(
    "range_slice",
    f"""SELECT pos, doc_id FROM (
  SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos, doc_id FROM documents)
WHERE pos >= {SLICE[0]} AND pos < {SLICE[1]}""",
)
def range_slice(spark: SparkSession, d: str) -> DataFrame:
    """E1 + B5: ``df[100:600]`` by document order, with a distributed ordinal."""
    docs = ordinal.with_ordinal(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return ordinal.positional_slice(docs, *SLICE).select("pos", "doc_id")


@query(
    "sentence_split",
    r"""SELECT doc_id, CAST(t.n - 1 AS BIGINT) AS sent_no, t.s AS sentence
FROM documents, unnest(string_split(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)))
     WITH ORDINALITY AS t(s, n)""",
)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences after ``.?!`` + whitespace, one row each."""
    docs = spread(table(spark, d, "documents"))
    return docs.select("doc_id", F.posexplode(T.sentence_split("text")).alias("sent_no", "sentence")).select(
        "doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "sentence"
    )


@query(
    "prefix_split",
    """SELECT doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 10), ' ') AS prompt,
       array_to_string(list_slice(string_split(text, ' '), 11, len(string_split(text, ' '))), ' ')
         AS target
FROM documents""",
)
def prefix_split(spark: SparkSession, d: str) -> DataFrame:
    """First ten words as the prompt, the rest as the target."""
    docs = spread(table(spark, d, "documents"))
    head, tail = T.prefix_words("text", 10)
    return docs.select("doc_id", head.alias("prompt"), tail.alias("target"))


SQL_ABS_OK = (
    "list_min(list_transform(string_split(abstract, chr(10)), "
    "lambda l: CAST(len(string_split(l, ': ')) >= 2 AS INTEGER))) = 1"
)


@query(
    "abstract_strip",
    f"""WITH {fx.SQL_ABSTRACTS}
SELECT doc_id, array_to_string(list_transform(string_split(abstract, chr(10)),
         lambda l: string_split(l, ': ')[2]), ' ') AS text
FROM abstracts WHERE {SQL_ABS_OK}""",
)
def abstract_strip(spark: SparkSession, d: str) -> DataFrame:
    """H7: labelled abstract lines reduced to their text, joined by a space."""
    a = spread(fx.abstracts(spark, d))
    return a.filter(~T.abstract_is_faulty("abstract")).select(
        "doc_id", T.strip_line_labels("abstract").alias("text")
    )


@query(
    "abstract_faulty",
    f"""WITH {fx.SQL_ABSTRACTS}
SELECT doc_id, CAST(len(string_split(abstract, chr(10))) AS BIGINT) AS n_lines
FROM abstracts WHERE NOT ({SQL_ABS_OK})""",
)
def abstract_faulty(spark: SparkSession, d: str) -> DataFrame:
    """The quarantined records (a line without ``": "``)."""
    a = spread(fx.abstracts(spark, d))
    return a.filter(T.abstract_is_faulty("abstract")).select(
        "doc_id", F.size(F.split("abstract", "\n", -1)).cast("bigint").alias("n_lines")
    )


@query(
    "provenance_union",
    """SELECT 'documents' AS corpus, doc_id AS id, text FROM documents
UNION ALL SELECT 'benchmark' AS corpus, item_id AS id, text FROM benchmark""",
)
def provenance_union(spark: SparkSession, d: str) -> DataFrame:
    """Corpora concatenated with a provenance tag, duplicates kept."""
    a = table(spark, d, "documents").select(F.lit("documents").alias("corpus"),
                                            F.col("doc_id").alias("id"), "text")
    b = table(spark, d, "benchmark").select(F.lit("benchmark").alias("corpus"),
                                            F.col("item_id").alias("id"), "text")
    return a.unionByName(b)


@query(
    "resume_anti",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
)
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Documents not yet in the ledger (``labels`` holds the done keys)."""
    return joins.skip_done(table(spark, d, "documents").select("doc_id"),
                           table(spark, d, "labels"), ["doc_id"])


@query("label_filter", "SELECT doc_id, toxic FROM labels WHERE quality = 1")
def label_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose boolean label is true."""
    return table(spark, d, "labels").filter(F.col("quality") == 1).select("doc_id", "toxic")


@query(
    "gold_vs_pred",
    f"""SELECT d.lang, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN l.quality = CASE WHEN {SQL_WORD_COUNT.format(c='d.text')} >= 100
                                      THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS BIGINT) AS n_agree,
       round(avg(CASE WHEN l.quality = CASE WHEN {SQL_WORD_COUNT.format(c='d.text')} >= 100
                                      THEN 1 ELSE 0 END THEN 1.0e0 ELSE 0.0e0 END), 6) AS agree_rate
FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang""",
)
def gold_vs_pred(spark: SparkSession, d: str) -> DataFrame:
    """Gold label beside a prediction (here: the >= 100 words rule), with
    the agreement rate per language."""
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", (T.word_count("text") >= 100).cast("int").alias("pred"))
    j = table(spark, d, "labels").join(docs, "doc_id")
    agree = (F.col("quality") == F.col("pred"))
    return j.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(agree.cast("bigint")).alias("n_agree"),
        F.round(F.avg(F.when(agree, 1.0).otherwise(0.0)), 6).alias("agree_rate"),
    )


# ---- coverage (relational division) -----------------------------------------
# Questions are conversations; each names three page titles by modular
# arithmetic.  Corpus titles are documents with >= 100 words, titled
# "doc<doc_id mod 500>" so that some titles repeat (first one wins in C4).

def _coverage_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    conv = table(spark, d, "conversations").select("conv_id").distinct()
    t = lambda a, b: F.concat(F.lit("doc"), ((F.col("conv_id") * a + b) % 500).cast("string"))
    items = conv.select(F.col("conv_id").alias("qid"),
                        F.array(t(7, 0), t(13, 5), t(31, 11)).alias("titles"))
    docs = table(spark, d, "documents")
    corpus = docs.filter(T.word_count("text") >= 100).select(
        F.concat(F.lit("doc"), (F.col("doc_id") % 500).cast("string")).alias("title"), "doc_id")
    return items, corpus


SQL_COVERAGE = """items AS (
  SELECT DISTINCT conv_id AS qid FROM conversations),
pairs AS (
  SELECT qid, 'doc' || CAST((qid * 7 + 0) % 500 AS VARCHAR) AS title FROM items
  UNION ALL SELECT qid, 'doc' || CAST((qid * 13 + 5) % 500 AS VARCHAR) FROM items
  UNION ALL SELECT qid, 'doc' || CAST((qid * 31 + 11) % 500 AS VARCHAR) FROM items),
corpus AS (
  SELECT 'doc' || CAST(doc_id % 500 AS VARCHAR) AS title, doc_id FROM documents
  WHERE """ + SQL_WORD_COUNT.format(c="text") + """ >= 100),
missing AS (SELECT * FROM pairs WHERE title NOT IN (SELECT title FROM corpus)),
covered AS (SELECT qid FROM items WHERE qid NOT IN (SELECT qid FROM missing))"""


@query("coverage_division", f"WITH {SQL_COVERAGE}\nSELECT qid FROM covered")
def coverage_division(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose every supporting title is in the corpus."""
    items, corpus = _coverage_inputs(spark, d)
    ok, _ = joins.covered(items, "qid", "titles", corpus)
    return ok.select("qid")


@query(
    "coverage_missing",
    f"""WITH {SQL_COVERAGE}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM items) AS n_questions,
       (SELECT CAST(count(*) AS BIGINT) FROM missing) AS missing_pairs,
       (SELECT CAST(count(DISTINCT qid) AS BIGINT) FROM missing) AS missing_questions,
       (SELECT CAST(count(*) AS BIGINT) FROM covered) AS covered_questions""",
)
def coverage_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing (question, title) occurrences and missing questions, both."""
    items, corpus = _coverage_inputs(spark, d)
    _, missing = joins.covered(items, "qid", "titles", corpus)
    per_q = items.join(missing.groupBy("qid").agg(F.count(F.lit(1)).alias("m")), "qid", "left")
    return per_q.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("missing_pairs"),
        F.count_if(F.col("m") > 0).cast("bigint").alias("missing_questions"),
        F.count_if(F.col("m").isNull()).cast("bigint").alias("covered_questions"),
    )


@query(
    "title_lookup",
    f"""WITH {SQL_COVERAGE},
firsts AS (SELECT title, min(doc_id) AS doc_id FROM corpus GROUP BY title)
SELECT p.qid, p.title, f.doc_id FROM pairs p JOIN covered c ON c.qid = p.qid
JOIN firsts f ON f.title = p.title""",
)
def title_lookup(spark: SparkSession, d: str) -> DataFrame:
    """C4 + D9: for covered questions, each title's first page."""
    items, corpus = _coverage_inputs(spark, d)
    ok, _ = joins.covered(items, "qid", "titles", corpus)
    pairs = ok.select("qid", F.explode("titles").alias("title"))
    return joins.lookup_first(pairs, corpus, "title", "doc_id").select("qid", "title", "doc_id")


@query(
    "stage_counts",
    f"""WITH {fx.SQL_ABSTRACTS}
SELECT CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) FILTER (WHERE {SQL_WORD_COUNT.format(c='d.text')} >= 100) AS BIGINT) AS ge_100_words,
  CAST(count(*) FILTER (WHERE NOT ({SQL_ABS_OK})) AS BIGINT) AS faulty_abstracts,
  CAST(count(*) FILTER (WHERE d.lang = 'en') AS BIGINT) AS english
FROM documents d JOIN abstracts a ON a.doc_id = d.doc_id""",
)
def stage_counts_query(spark: SparkSession, d: str) -> DataFrame:
    """The row counts the reference printed after each step, as one pass
    of conditional counts (no repeated count actions)."""
    from quarry.operators.agg import stage_counts

    docs = table(spark, d, "documents").withColumn("abstract", fx.abstract_of("text", "doc_id"))
    return stage_counts(docs, {
        "ge_100_words": T.word_count("text") >= 100,
        "faulty_abstracts": T.abstract_is_faulty("abstract"),
        "english": F.col("lang") == "en",
    }).select(F.col("n_rows").cast("bigint").alias("n_rows"), "ge_100_words", "faulty_abstracts", "english")
