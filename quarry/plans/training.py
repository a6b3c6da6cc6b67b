"""Training-set preparation queries: chunking, token ids, packed blocks,
prefix features, padded question batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.text import whitespace_tokens
from quarry.operators import chunk as C
from quarry.operators import pack as P
from quarry.operators.agg import length_summary
from quarry.operators.layout import spread
from quarry.plans import fixtures as fx
from quarry.plans.registry import query
from quarry.plans.retrieval import sql_tokens
from quarry.session import materialize
from quarry.sources.tables import table

BLOCK = 1024
BATCH_ROWS = 1000
MAX_LENGTH = 1024


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def sql_chunks(size: int, overlap: int, separators: list[str]) -> str:
    """CTEs ending in ``chunks(doc_id, chunk_no, start, text)``, the chunker's contract as SQL.

    One set of CTEs per nesting level cuts bodies at the first separator that
    occurs and hands pieces that are too long to the next level.  Runs of short
    pieces are merged from their prefix sums ``p``: a chunk of the pieces from
    ``l`` on ends before the first piece that would make it too long, and the
    next one begins at the first piece that keeps the overlap."""
    quoted = ["'" + x.replace("\n", "' || chr(10) || '") + "'" for x in separators]
    out = ["in0 AS (SELECT doc_id, CAST(0 AS BIGINT) AS base, text AS body, 0 AS k FROM documents WHERE text <> '')"]
    shorts, longs = [], []
    for n in range(len(separators)):
        pick = " ".join(
            f"WHEN k <= {j} AND " + (f"contains(body, {q})" if x else "true") + f" THEN {j}"
            for j, (x, q) in enumerate(zip(separators, quoted, strict=True)))
        cuts = " ".join(f"WHEN {j} THEN string_split(body, {q})" for j, q in enumerate(quoted))
        heads = " ".join(f"WHEN {j} THEN {q}" for j, q in enumerate(quoted))
        ends = [j for j, x in enumerate(separators) if not x or j + 1 == len(separators)]
        out += [
            f"pick{n} AS (SELECT *, CASE {pick} ELSE -1 END AS j FROM in{n})",
            f"cut{n} AS (SELECT doc_id, base, j, t.n, CASE WHEN t.n > 1 THEN CASE j {heads} ELSE '' END ELSE '' END || t.x"
            f" AS piece FROM pick{n}, unnest(CASE j {cuts} ELSE [body] END) WITH ORDINALITY AS t(x, n))",
            f"len{n} AS (SELECT *, length(piece) AS len FROM cut{n} WHERE piece <> '')",
            f"at{n} AS (SELECT *, base + CAST(sum(len) OVER w - len AS BIGINT) AS start,"
            f" sum(CAST(len >= {size} AS INT)) OVER w AS g FROM len{n}"
            f" WINDOW w AS (PARTITION BY doc_id, base ORDER BY n))",
            f"in{n + 1} AS (SELECT doc_id, start AS base, piece AS body, j + 1 AS k FROM at{n}"
            f" WHERE len >= {size} AND j >= 0 AND j NOT IN ({', '.join(map(str, ends))}))",
        ]
        shorts.append(f"SELECT doc_id, base, g, start, len FROM at{n} WHERE len < {size}")
        longs.append(f"SELECT doc_id, start, piece AS text FROM at{n} WHERE len >= {size}"
                     f" AND (j < 0 OR j IN ({', '.join(map(str, ends))}))")
    out += [
        "short AS (" + " UNION ALL ".join(shorts) + ")",
        "sums AS (SELECT doc_id, base, g, start, len, sum(len) OVER (PARTITION BY doc_id, base, g ORDER BY start) AS p FROM short)",
        "runs AS (SELECT doc_id, base, g, min(start) AS s0, list_prepend(0, list(CAST(p AS BIGINT) ORDER BY start)) AS p"
        " FROM sums GROUP BY doc_id, base, g)",
        # l and r are 1-based places in p: the chunk holds the pieces from l to r - 1.
        f"""merged(doc_id, s0, p, l, r) AS (
  SELECT doc_id, s0, p, 1, coalesce(list_filter(range(2, len(p)), lambda x: p[x + 1] - p[1] > {size})[1], len(p))
  FROM runs
  UNION ALL
  SELECT doc_id, s0, p, l2,
    coalesce(list_filter(range(l2 + 1, len(p)), lambda x: p[x + 1] - p[l2] > {size})[1], len(p))
  FROM (SELECT doc_id, s0, p, list_filter(range(l, r + 1), lambda x: p[r] - p[x] <= {overlap}
          AND (p[r + 1] - p[x] <= {size} OR p[x] = p[r]))[1] AS l2
        FROM merged WHERE r < len(p)))""",
        "raw AS (SELECT m.doc_id, s0 + p[l] AS start, substr(d.text, s0 + p[l] + 1, p[r] - p[l]) AS text"
        " FROM merged m JOIN documents d ON d.doc_id = m.doc_id)",
        r"bare AS (SELECT doc_id, start + length(regexp_extract(text, '^\s*')) AS start,"
        r" regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM raw)",
        "alltext AS (SELECT * FROM bare WHERE text <> '' UNION ALL " + " UNION ALL ".join(longs) + ")",
        "chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS chunk_no,"
        " CAST(start AS BIGINT) AS start, text FROM alltext)",
    ]
    return "WITH RECURSIVE " + ",\n".join(out)


@query("chunk_sentence", sql_chunks(1750, 100, C.SENTENCE_SEPARATORS) + "\nSELECT * FROM chunks")
def chunk_sentence(spark: SparkSession, d: str) -> DataFrame:
    """J1 + J3: chunks cut on ``". "`` only, 1750 characters, overlap 100."""
    return C.chunk(_docs(spark, d), size=1750, overlap=100, separators=C.SENTENCE_SEPARATORS)


@query("chunk_recursive", sql_chunks(2000, 100, C.DEFAULT_SEPARATORS) + "\nSELECT * FROM chunks")
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    """J2 + J3: recursive chunks with the default separators, 2000/100."""
    return C.chunk(_docs(spark, d), size=2000, overlap=100)


@query(
    "chunk_stats",
    sql_chunks(2500, 100, C.DEFAULT_SEPARATORS)
    + """, n AS (SELECT CAST(len(string_split(text, ' ')) AS BIGINT) AS w FROM chunks)
SELECT CAST(count(*) AS BIGINT) AS n_chunks, min(w) AS min_words, max(w) AS max_words,
  round(avg(w), 6) AS avg_words, median(w) AS median_words FROM n""",
)
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Words per chunk of the 2500/100 recursive chunks, summarised."""
    ch = C.chunk(_docs(spark, d), size=2500, overlap=100)
    return length_summary(ch, F.size(F.split("text", " ", -1)))


SQL_VOCAB = f"""toks AS (SELECT doc_id, t.word, t.n FROM documents,
                 unnest({sql_tokens('text')}) WITH ORDINALITY AS t(word, n)),
vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS id
          FROM toks GROUP BY word),
ids AS (SELECT doc_id, list(id ORDER BY n) AS ids FROM toks JOIN vocab USING (word) GROUP BY doc_id),
dids AS (SELECT d.doc_id, coalesce(i.ids, []::BIGINT[]) AS ids
         FROM documents d LEFT JOIN ids i ON i.doc_id = d.doc_id)"""


def _doc_ids(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, d)
    vocab = P.build_vocab(docs)
    return P.tokenize(docs, vocab, key_cols=["doc_id"], text=F.col("text")), vocab


@query(
    "tokenize_ids",
    f"""WITH {SQL_VOCAB}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, array_to_string(ids, ' ') AS ids FROM dids""",
)
def tokenize_ids(spark: SparkSession, d: str) -> DataFrame:
    """Whitespace words to ids by a frequency-ranked vocabulary."""
    ids, _ = _doc_ids(spark, d)
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.array_join("ids", " ").alias("ids"))


@query(
    "pack_blocks",
    f"""WITH {SQL_VOCAB},
p AS (SELECT ids, len(ids) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM dids),
b AS (SELECT ids, n, pos, pos // {BATCH_ROWS} AS batch,
        CAST(sum(n) OVER (PARTITION BY pos // {BATCH_ROWS} ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS start,
        CAST(sum(n) OVER (PARTITION BY pos // {BATCH_ROWS}) AS BIGINT) AS total FROM p),
f AS (SELECT batch, start, n, ids, total,
        unnest(range(start // {BLOCK}, (start + n - 1) // {BLOCK} + 1)) AS blk FROM b WHERE n > 0),
g AS (SELECT batch, blk, start,
        ids[greatest(start, blk * {BLOCK}) - start + 1 : least(start + n, (blk + 1) * {BLOCK}) - start]
          AS frag
      FROM f WHERE blk < total // {BLOCK})
SELECT CAST(batch AS BIGINT) AS batch, CAST(blk AS BIGINT) AS block,
  string_agg(array_to_string(frag, ' '), ' ' ORDER BY start) AS input_ids,
  string_agg(array_to_string(frag, ' '), ' ' ORDER BY start) AS labels
FROM g GROUP BY batch, blk""",
)
def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    """J5 + J6: 1000-row batches packed into 1024-token blocks."""
    ids, _ = _doc_ids(spark, d)
    blocks = P.pack(ids, order_col="doc_id", ids_col="ids", block=BLOCK, batch_rows=BATCH_ROWS,
                    keys=table(spark, d, "documents").select("doc_id"))
    return blocks.select("batch", F.col("block").cast("bigint").alias("block"),
                         F.array_join("input_ids", " ").alias("input_ids"),
                         F.array_join("labels", " ").alias("labels"))


_HEAD = "array_to_string(list_slice(string_split(text, ' '), 1, 10), ' ')"
_TAIL = "array_to_string(list_slice(string_split(text, ' '), 11, len(string_split(text, ' '))), ' ')"


@query(
    "prefix_labels",
    f"""WITH {SQL_VOCAB},
pt AS (SELECT doc_id, {_HEAD} AS prompt, {_TAIL} AS target FROM documents),
ptoks AS (SELECT doc_id, 'p' AS part, t.word, t.n FROM pt,
            unnest({sql_tokens('prompt')}) WITH ORDINALITY AS t(word, n)
          UNION ALL
          SELECT doc_id, 't' AS part, t.word, t.n FROM pt,
            unnest({sql_tokens('target')}) WITH ORDINALITY AS t(word, n)),
pid AS (SELECT doc_id, part, list(id ORDER BY n) AS ids FROM ptoks JOIN vocab USING (word)
        GROUP BY doc_id, part),
x AS (SELECT d.doc_id,
        list_resize(coalesce(p.ids, []::BIGINT[])[1:{MAX_LENGTH}], {MAX_LENGTH}, 0) AS inp,
        list_resize(coalesce(t.ids, []::BIGINT[])[1:{MAX_LENGTH}], {MAX_LENGTH}, 0) AS tgt
      FROM documents d LEFT JOIN pid p ON p.doc_id = d.doc_id AND p.part = 'p'
                       LEFT JOIN pid t ON t.doc_id = d.doc_id AND t.part = 't')
SELECT doc_id, array_to_string(inp, ' ') AS input_ids,
  array_to_string(list_transform(inp, lambda v: CASE WHEN v = 0 THEN 0 ELSE 1 END), ' ')
    AS attention_mask,
  array_to_string(list_transform(tgt, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END), ' ') AS labels
FROM x""",
)
def prefix_labels(spark: SparkSession, d: str) -> DataFrame:
    """H12 + J4 + J7: ten-word prompt and the rest as target, each cut and
    right-padded to 1024 ids; target padding becomes -100."""
    docs = _docs(spark, d)
    head, _ = T.prefix_words("text", 10)
    # The prompt's words are the text's first ones: tokenized once, cut at their number.
    pt = docs.select("doc_id", "text", F.size(whitespace_tokens(head)).alias("k"))
    ids = P.tokenize(pt, P.build_vocab(docs), key_cols=["doc_id", "k"], text=F.col("text"))
    rest = F.greatest(F.size("ids") - F.col("k"), F.lit(0))
    feats = ids.select("doc_id", *P.prefix_features(F.slice("ids", F.lit(1), F.col("k")),
                                                    F.slice("ids", F.col("k") + 1, rest), MAX_LENGTH))
    return feats.select("doc_id", *[F.array_join(c, " ").alias(c)
                                    for c in ("input_ids", "attention_mask", "labels")])


@query(
    "pad_batch",
    f"""WITH {fx.SQL_QUESTIONS},
qt AS (SELECT conv_id, turn, t.word, t.n FROM questions,
         unnest({sql_tokens('question')}) WITH ORDINALITY AS t(word, n)),
vocab AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS id FROM qt GROUP BY word),
qi AS (SELECT q.conv_id, q.turn, coalesce(i.ids, []::BIGINT[]) AS ids FROM questions q LEFT JOIN
        (SELECT conv_id, turn, list(id ORDER BY n) AS ids FROM qt JOIN vocab USING (word)
         GROUP BY conv_id, turn) i ON i.conv_id = q.conv_id AND i.turn = q.turn),
m AS (SELECT max(len(ids)) AS L FROM qi)
SELECT conv_id, turn,
  array_to_string(list_concat(list_transform(range(L - len(ids)), lambda x: 0), ids), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(range(L - len(ids)), lambda x: 0),
                              list_transform(ids, lambda x: 1)), ' ') AS attention_mask
FROM qi, m""",
)
def pad_batch(spark: SparkSession, d: str) -> DataFrame:
    """J4 + J8: question ids left-padded to the longest question of the call,
    with the attention mask."""
    q = spread(fx.questions(spark, d))
    vocab = P.build_vocab(q, "question")
    ids = P.tokenize(q, vocab, key_cols=["conv_id", "turn"], text=F.col("question"))
    ids = materialize(ids)
    longest = ids.agg(F.max(F.size("ids"))).first()[0] or 0
    return ids.select("conv_id", "turn", *P.pad_left(F.col("ids"), int(longest))).select(
        "conv_id", "turn", F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", " ").alias("attention_mask"))


SHARDS = 3


@query(
    "pack_shards",
    f"""WITH {SQL_VOCAB},
c AS (SELECT count(*) AS n FROM documents),
p0 AS (SELECT ids, len(ids) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM dids),
p1 AS (SELECT p0.*, c.n // {SHARDS} AS small, c.n % {SHARDS} AS extra FROM p0, c),
p AS (SELECT ids, n, pos, CASE WHEN pos < extra * (small + 1) THEN pos // (small + 1)
        ELSE extra + (pos - extra * (small + 1)) // greatest(small, 1) END AS shard FROM p1),
q AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY pos) - 1) // 100 AS batch FROM p),
b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY shard, batch ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) AS start,
        CAST(sum(n) OVER (PARTITION BY shard, batch) AS BIGINT) AS total FROM q),
f AS (SELECT *, unnest(range(start // 512, (start + n - 1) // 512 + 1)) AS blk FROM b WHERE n > 0),
g AS (SELECT shard, batch, blk, start,
        ids[greatest(start, blk * 512) - start + 1 : least(start + n, (blk + 1) * 512) - start] AS frag
      FROM f WHERE blk < total // 512)
SELECT CAST(shard AS BIGINT) AS shard, CAST(batch AS BIGINT) AS batch, CAST(blk AS BIGINT) AS block,
  md5(string_agg(array_to_string(frag, ' '), ' ' ORDER BY start)) AS ids_md5,
  CAST(512 AS BIGINT) AS n_attended
FROM g GROUP BY shard, batch, blk""",
)
def pack_shards(spark: SparkSession, d: str) -> DataFrame:
    """J4 + J5 + J6 over three shards: ids and attention masks cut alike."""
    docs = _docs(spark, d)
    ids = P.tokenize(docs, P.build_vocab(docs), key_cols=["doc_id"], text=F.col("text"), mask="attention_mask")
    blocks = P.pack(ids, order_col="doc_id", block=512, batch_rows=100, num_shards=SHARDS,
                    more_cols=("attention_mask",), keys=table(spark, d, "documents").select("doc_id"))
    return blocks.select("shard", "batch", F.col("block").cast("bigint").alias("block"),
                         F.md5(F.array_join("input_ids", " ")).alias("ids_md5"),
                         F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attended"))


def word_lengths():
    """A user's tokenizer for the test data: the length of each word."""
    return lambda texts: [[len(w) for w in t.split(" ") if w] for t in texts]


@query(
    "user_tokenizer",
    """SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''),
  lambda w: length(w)), ' ') AS ids FROM documents""",
)
def user_tokenizer(spark: SparkSession, d: str) -> DataFrame:
    """J4 with a user's tokenizer."""
    ids = P.tokenize(_docs(spark, d), key_cols=["doc_id"], text=F.col("text"), tokenizer=word_lengths)
    return ids.select("doc_id", F.array_join("ids", " ").alias("ids"))
