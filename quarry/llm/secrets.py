"""Operator 1: secret scan by patterns and character Markov models.

The base patterns give spans of three kinds.  A fourth kind, ``random``, comes
from two first-order Markov models over characters: one of random strings, one
of ordinary identifiers.  Both are trained on samples that the patterns label:
the secret part of a base span is a random string, a word of the text outside
of them an ordinary one.  A candidate (a long run of token characters with a
letter and a digit, apart from every base span) is a span if the log-likelihood
ratio of the two models, per transition, reaches ``MARGIN``.

Only column expressions and SQL aggregates are used.  The models are counts of
character pairs, at most ``(len(ALPHABET) + 1) ** 2`` for each label whatever
the input, so they are collected and become literals of the scoring pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scan, text_of
from quarry.llm.registry import llm_query
from quarry.session import materialize

#: Patterns and least lengths of the base kinds (fixed values, in listed order).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

#: Characters of the models, case folded; all others share one place.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CANDIDATE_LEAST = 18
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}"
PIECE = rf"[A-Za-z0-9]{{{CANDIDATE_LEAST},}}"
#: Words that are trained on as ordinary identifiers.
WORDS = r"[A-Za-z0-9_]{6,}"
#: Least mean log-likelihood ratio of a transition, in nats, and least length: of
#: strings with letters and digits, of letters alone, of digits alone.
MARGINS = {"mixed": (0.7, 18), "letters": (1.0, 20), "digits": (0.7, 24)}
#: Letters from which a piece is a word that a random string does not hold, if its ratio is below 0.
WORD_LEAST = 5
#: Share of each model that is uniform, by label: a random string may hold any
#: character, an ordinary one seldom does.
UNIFORM = {1: 0.1, 0: 0.01}
#: Distinct strings of either label that the models are fitted on, about, at
#: most (those whose hash falls below the share that this is of them).
SAMPLE = 200_000


def _long(column: Column, least: int) -> Column:
    return F.length(column) >= least


def _spans(text: Column, kind: str, pattern: str, good) -> Column:
    """All matches of ``pattern`` for which ``good(match)`` holds, as structs.

    Splitting gives the pieces between matches, so starts are sums of lengths
    in code points; texts without a match stop after the split."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,body:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc, pair):
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["body"])
        span = F.struct(
            begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), pair["body"].alias("body")
        )
        kept = F.when(good(pair["body"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("body"))
    return F.when(F.size(gaps) < 2, empty).otherwise(F.aggregate(pairs, start, step)["spans"])


def secret_part(body: Column) -> Column:
    """What an assignment assigns."""
    return F.regexp_extract(body, ASSIGN, 2)


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start, then kind.

    The bounds of access and hex spans are part of their patterns: a run that
    is too short holds no longer one."""
    return F.array_sort(
        F.concat(
            _spans(text, "assign", ASSIGN, lambda m: _long(secret_part(m), ASSIGN_LEAST)),
            _spans(text, "access", ACCESS, lambda m: _long(m, ACCESS_LEAST)),
            _spans(text, "hex", HEX[:-1] + f"{{{HEX_LEAST},}}", lambda m: F.lit(True)),
        ),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]),
    )


def spell(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def labelled_strings(rows: DataFrame) -> DataFrame:
    """Distinct ``(body, label)``: 1 the secret parts of base spans, 0 ordinary words.

    ``rows`` has ``_text`` and ``_base``.  Words are taken from the text with
    its base bodies blanked out; those that the models will have to judge do
    not train them.  Distinct strings are found by partial aggregation, so a
    word of every document costs one row a task."""
    random = F.transform("_base", lambda s: F.when(s["kind"] == 0, secret_part(s["body"])).otherwise(s["body"]))
    clean = F.aggregate("_base", F.col("_text"), lambda t, s: F.replace(t, s["body"], F.lit(" ")))
    words = F.array_distinct(F.regexp_extract_all(clean, F.lit(WORDS), F.lit(0)))
    words = F.filter(words, lambda w: ~_judged(w))

    def as_label(strings: Column, label: int) -> Column:
        return F.transform(strings, lambda x: F.struct(F.lower(x).alias("body"), F.lit(label).alias("label")))

    both = F.concat(as_label(random, 1), as_label(words, 0))
    return rows.select(F.explode(both).alias("_s")).select("_s.body", "_s.label").distinct()


def train(samples: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of all character pairs, row by row of the alphabet.

    ``samples`` has distinct ``body`` and ``label`` (1 random, 0 ordinary).  A
    label without samples has a uniform model."""
    size, scale = len(ALPHABET) + 1, 1 << 32
    held = {r["label"]: r["n"] for r in samples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {v: min(1.0, sample / held[v]) if v in held else 1.0 for v in (0, 1)}
    bound = F.when(F.col("label") == 1, F.lit(int(share[1] * scale))).otherwise(F.lit(int(share[0] * scale)))
    at = F.sequence(F.lit(1), F.length("body") - 1)
    pairs = (
        samples.filter((F.length("body") > 1) & (F.pmod(F.xxhash64("body"), F.lit(scale)) < bound))
        .select("label", F.explode(F.transform(at, lambda k: F.substring("body", k, F.lit(2)))).alias("p"))
        .withColumn("p", F.regexp_replace("p", r"[^a-z0-9+/_=\-.]", " "))
    )
    place = {c: k for k, c in enumerate(ALPHABET)}
    counts = {v: [[0] * size for _ in range(size)] for v in (0, 1)}
    # One row for each pair of places and label at most.
    for r in pairs.groupBy("label", "p").agg(F.count(F.lit(1)).alias("n")).collect():
        a, b = (place.get(c, size - 1) for c in r["p"])
        counts[r["label"]][a][b] += r["n"]

    def chance(v: int, a: int, b: int) -> float:
        row = counts[v][a]
        own = row[b] / sum(row) if any(row) else 1 / size
        return (1 - UNIFORM[v]) * own + UNIFORM[v] / size

    return [math.log(chance(1, a, b)) - math.log(chance(0, a, b)) for a in range(size) for b in range(size)]


def _mixed(body: Column) -> Column:
    """Whether a string has a digit and a letter."""
    return body.rlike("[0-9]") & body.rlike("[A-Za-z]")


def _sorts(body: Column) -> list[tuple[Column, float, int]]:
    """Each sort of strings, as a condition, with its margin and least length."""
    digit, letter = body.rlike("[0-9]"), body.rlike("[A-Za-z]")
    conditions = {"mixed": digit & letter, "letters": letter & ~digit, "digits": digit & ~letter}
    return [(conditions[k], *limits) for k, limits in MARGINS.items()]


def _judged(body: Column) -> Column:
    """Whether a string is long enough of its sort to be judged by the models."""
    out = F.lit(False)
    for condition, _, least in _sorts(body):
        out = F.when(condition, F.length(body) >= least).otherwise(out)
    return out


def mean_ratio(body: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of ``body`` (2 characters or more)."""
    size, body = len(ALPHABET) + 1, F.lower(body)
    table = F.split(F.lit(" ".join(map(repr, ratios))), " ").cast("array<double>")

    def place(k: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), F.substring(body, k, F.lit(1)))
        return F.when(at > 0, at - 1).otherwise(size - 1)

    steps = F.sequence(F.lit(1), F.length(body) - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda acc, k: acc + F.get(table, place(k) * size + place(k + 1)))
    return total / (F.length(body) - 1)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256``, ``spans``, and ``n_random``.

    Null counts as the empty text, which has no spans (``spans`` is empty and
    ``base_sha256`` that of the empty string).  Starts and ends count code
    points, the end is exclusive.  Repeated rows give repeated results and
    train once.  Without base spans in the whole table the model of random
    strings is uniform.  An empty table gives an empty result.  Other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_base", base_spans(F.col("_text")))
    ratios = train(materialize(labelled_strings(rows)))

    def reaches(body: Column) -> Column:
        ratio, out = mean_ratio(body, ratios), F.lit(False)
        for condition, margin, _ in _sorts(body):
            out = F.when(condition, ratio >= margin).otherwise(out)
        return F.when(_judged(body), out).otherwise(F.lit(False))

    def ordinary(piece: Column) -> Column:
        word = (F.length(piece) >= WORD_LEAST) & ~piece.rlike("[0-9]")
        return F.when(word, mean_ratio(piece, ratios) < 0).otherwise(F.lit(False))

    def whole(body: Column) -> Column:
        holds_word = F.exists(F.split(body, "[^A-Za-z0-9]+", -1), ordinary)
        return F.when(_mixed(body), reaches(body) & ~holds_word).otherwise(F.lit(False))

    def clear_of(spans: str, others: str) -> Column:
        return F.filter(
            spans, lambda m: ~F.exists(others, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    found = rows.withColumn("_runs", _spans(F.col("_text"), "random", CANDIDATE, whole))
    found = found.withColumn("_pieces", _spans(F.col("_text"), "random", PIECE, reaches))
    found = found.withColumn("_more", F.concat("_runs", clear_of("_pieces", "_runs")))
    apart = clear_of("_more", "_base")
    every = F.array_sort(
        F.concat("_base", apart),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]),
    )

    def number(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.withColumn("_all", every).select(
        id_col, *[number("_base", k) for k in KINDS[:3]],
        F.sha2(spell(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        spell(F.col("_all")).alias("spans"), number("_all", "random"),
    )


@llm_query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return find_secrets(scan(spark, sf_dir).select("doc_id", "text"))
