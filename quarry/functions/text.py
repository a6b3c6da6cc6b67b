"""Scalar string functions (column expressions only, all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's ``str.split()`` / ``str.strip()`` treat
# as whitespace, as one regex character class usable by Java regex and RE2.
PY_WS_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def whitespace_tokens(col: str | Column) -> Column:
    """``text.split()``: split on whitespace runs, drop empty pieces, keep case."""
    return F.array_remove(F.split(_c(col), PY_WS_CLASS + "+", -1), "")


def word_count(col: str | Column) -> Column:
    """``len(str(text).split(" "))``: empty pieces count, null counts as ``nan``."""
    return F.size(F.split(F.coalesce(_c(col).cast("string"), F.lit("nan")), " ", -1)).cast(
        "bigint"
    )


def py_strip(col: str | Column) -> Column:
    """``str.strip()``: Spark's ``btrim`` leaves newlines, so use the class."""
    return F.regexp_replace(_c(col), f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")


def remove_newlines(col: str | Column) -> Column:
    """``s.replace("\\n", "")``."""
    return F.replace(_c(col), F.lit("\n"), F.lit(""))


def remove_echo(output: str | Column, prompt: str | Column) -> Column:
    """Generated text minus every copy of its prompt, stripped (``out.replace(q,'').strip()``).

    An empty prompt leaves the text as it is (Python's ``replace('', '')``
    is the identity on the text as well).
    """
    out, q = _c(output), _c(prompt)
    return py_strip(F.when(q == F.lit(""), out).otherwise(F.replace(out, q, F.lit(""))))


# The six deletions applied to Wikipedia text, in this order.
# Four literal section headings, then an ISBN tail, then a link tail.
WIKI_DELETIONS = [
    "==REFERENCES==",
    "== References ==",
    "== Notes ==",
    "== Notes and references ==",
    r"ISBN.*",
    r"(https?:\S+?)/.*",
]


def wiki_clean(col: str | Column) -> Column:
    """Apply the six deletions.  ``(?dU)`` makes ``.`` stop only at ``\\n`` and
    ``\\S`` Unicode-aware, as Python's ``re`` does."""
    out = _c(col)
    for i, pat in enumerate(WIKI_DELETIONS):
        if i < 4:
            out = F.replace(out, F.lit(pat), F.lit(""))
        else:
            out = F.regexp_replace(out, "(?dU)" + pat, "")
    return out


def word_tokens(col: str | Column) -> Column:
    """Word tokenizer for the dictionary filter: letter/digit runs, or one
    non-space, non-word character (pinned rule, stands in for NLTK)."""
    return F.regexp_extract_all(_c(col), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), 0)


def strip_line_labels(col: str | Column) -> Column:
    """PubMed abstract: for every line take the text after the first ``": "``
    and before a second one; join with a space.  Null when any line lacks it."""
    lines = F.split(_c(col), "\n", -1)
    ok = F.forall(lines, lambda ln: F.size(F.split(ln, ": ", -1)) >= 2)
    body = F.array_join(F.transform(lines, lambda ln: F.get(F.split(ln, ": ", -1), 1)), " ")
    return F.when(ok, body)


def abstract_is_faulty(col: str | Column) -> Column:
    lines = F.split(_c(col), "\n", -1)
    return ~F.forall(lines, lambda ln: F.size(F.split(ln, ": ", -1)) >= 2)


# The question words and auxiliaries dropped by the question
# formatter (exact case, whole space-separated words).
QUESTION_WORDS = ["What", "Who", "Whom", "Whose", "Which", "Where", "When", "Why", "How"]
AUXILIARY_VERBS = ["Do", "Does", "Did", "Is", "Are", "Was", "Were", "Can", "Could", "Will", "Would"]


def format_question(col: str | Column) -> Column:
    """Delete ``?``, drop the listed words (split on one space), re-join."""
    words = F.array(*[F.lit(w) for w in QUESTION_WORDS + AUXILIARY_VERBS])
    pieces = F.split(F.replace(_c(col), F.lit("?"), F.lit("")), " ", -1)
    return F.array_join(F.filter(pieces, lambda w: ~F.array_contains(words, w)), " ")


def sentence_split(col: str | Column) -> Column:
    """``re.split(r"(?<=[.?!])\\s+", s)``."""
    return F.split(_c(col), r"(?<=[.?!])\s+", -1)


def prefix_words(col: str | Column, n: int = 10) -> tuple[Column, Column]:
    """(first n words, the rest) of ``text.split(" ")``, each joined by a space."""
    words = F.split(_c(col), " ", -1)
    head = F.array_join(F.slice(words, 1, n), " ")
    tail = F.array_join(
        F.when(F.size(words) > n, F.slice(words, n + 1, F.greatest(F.size(words) - n, F.lit(1))))
        .otherwise(F.array().cast("array<string>")),
        " ",
    )
    return head, tail


def site_name(col: str | Column) -> Column:
    """Stack Exchange site: text between ``//`` and the first following dot;
    ``''`` when there is no such dot."""
    return F.regexp_extract(_c(col), r"//([^.]*)\.", 1)
