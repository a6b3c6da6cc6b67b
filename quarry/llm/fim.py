"""Operator 12: fill-in-the-middle transformation by SWAR selection.

A text is cut at two unit boundaries into prefix, middle and suffix and put
into one of two orders, marked by sentinels.  Finding the boundaries needs the
k-th unit end of a text; it is found on the UTF-8 bytes of a whole Arrow batch
at once, eight bytes to a machine word:

1. the buffer is viewed as ``uint64`` words and arithmetic marks the high bit
   of every byte that ends a unit (a line feed) or leads a code point;
2. ``bitwise_count`` counts the marks of each word, a cumulative sum gives the
   marks before each word;
3. a binary search of the sums finds the word that holds a wanted mark, and a
   byte-wise running count inside that word selects the byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scan, slices, text_of
from quarry.llm.registry import llm_query

#: Sentinels before prefix, suffix and middle (fixed values of the contract).
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Percent of the texts that are transformed, and of those that take the order suffix first.
RATE, SPM_RATE = 100, 50
UNITS = ("line", "char")

LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH = np.uint64(0x8080808080808080)
ONES = np.uint64(0x0101010101010101)
FEEDS = np.uint64(0x0A0A0A0A0A0A0A0A)


def feed_marks(words: np.ndarray) -> np.ndarray:
    """High bit of every byte that is a line feed.  No carry leaves a byte, since
    seven bits plus 0x7F stay below 0x100."""
    other = words ^ FEEDS
    return ~(((other & LOW7) + LOW7) | other | LOW7)


def lead_marks(words: np.ndarray) -> np.ndarray:
    """High bit of every byte that leads a code point (is not of the form 10xxxxxx)."""
    return (~words | (words << np.uint64(1))) & HIGH


class Marks:
    """Rank and select over marked bytes of a buffer of words."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.sums = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.sums[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on the bytes before each byte position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        last = np.minimum(word, len(self.marks) - 1)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self.sums[word] + np.bitwise_count(self.marks[last] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position of the k-th mark, counted from 0; every k must exist."""
        word = np.searchsorted(self.sums, k, side="right") - 1
        rest = k - self.sums[word]
        # One in each marked byte; times ones, each byte holds the marks up to itself.
        upto = (self.marks[word] >> np.uint64(7)) * ONES
        byte = np.zeros(len(k), np.int64)
        for j in range(8):
            byte += ((upto >> np.uint64(8 * j)) & np.uint64(0xFF)).astype(np.int64) <= rest
        return word * 8 + byte


def words_of(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words; the last one is filled up with zeros."""
    fill = -len(data) % 8
    if fill or data.ctypes.data % 8:
        data = np.concatenate([data, np.zeros(fill, np.uint8)])
    return data.view("<u8")


def layout_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the offsets of its texts in them."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Units:
    """Unit counts and boundaries of all texts of a batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        words = words_of(data) if len(data) else np.zeros(1, np.uint64)
        self.starts, self.ends, self.unit = offsets[:-1], offsets[1:], unit
        self.leads = Marks(lead_marks(words))
        self.marks = Marks(feed_marks(words)) if unit == "line" else self.leads
        self.base = self.marks.rank(self.starts)
        self.n = self.marks.rank(self.ends) - self.base
        if unit == "line" and len(data):
            last = data[np.maximum(self.ends - 1, 0)]
            self.n = self.n + ((self.ends > self.starts) & (last != 0x0A))

    def boundary(self, k: np.ndarray) -> np.ndarray:
        """Byte position after the first k units of each text, 0 <= k <= n."""
        out = np.where(k > 0, self.ends, self.starts)
        inner = np.flatnonzero((k > 0) & (k < self.n))
        if len(inner):
            # A line ends on its k-th feed; code point k + 1 begins where k of them end.
            step = -1 if self.unit == "line" else 0
            at = self.marks.select((self.base + k + step)[inner])
            out[inner] = at + 1 if self.unit == "line" else at
        return out

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points between two boundaries."""
        return self.leads.rank(end) - self.leads.rank(start)


def transformed(texts: pa.Array, draws: list[np.ndarray], unit: str, rate: int, spm_rate: int) -> list[pa.Array]:
    """Unit counts, forms, prefix and middle sizes and outputs of a batch of texts."""
    data, offsets = layout_of(texts)
    h1, h2, h3, h4 = draws
    units = Units(data, offsets, unit)
    one, two = h1 % (units.n + 1), h2 % (units.n + 1)
    cut, end = units.boundary(np.minimum(one, two)), units.boundary(np.maximum(one, two))
    raw = data.tobytes()
    marked = [bytes(s, "ascii") for s in SENTINELS]
    prefix, suffix, middle = marked
    forms, outputs = [], []
    spm = h4 % 100 < spm_rate
    kept = (h3 % 100 >= rate) | (units.ends == units.starts)
    rows = zip(units.starts.tolist(), cut.tolist(), end.tolist(), units.ends.tolist(), spm.tolist(), kept.tolist())
    for a, b, c, d, swapped, plain in rows:
        if plain or any(raw.find(s, a, d) >= 0 for s in marked):
            forms.append("plain")
            outputs.append(raw[a:d])
        elif swapped:
            forms.append("spm")
            outputs.append(b"".join((suffix, raw[c:d], prefix, raw[a:b], middle, raw[b:c])))
        else:
            forms.append("psm")
            outputs.append(b"".join((prefix, raw[a:b], suffix, raw[c:d], middle, raw[b:c])))
    is_plain = np.array([f == "plain" for f in forms], bool)
    return [
        pa.array(units.n, pa.int64()),
        pa.array(forms, pa.string()),
        pa.array(units.chars(units.starts, cut), pa.int64(), mask=is_plain),
        pa.array(units.chars(cut, end), pa.int64(), mask=is_plain),
        pa.array(outputs, pa.binary()).cast(pa.string()),
    ]


def draws_of(id_col: str, seed: int) -> list[Column]:
    """Four 32-bit draws of a document, from the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    seed: int = SEED,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
) -> DataFrame:
    """One row per input row: id, ``n`` (units), ``form``, ``prefix_chars``,
    ``middle_chars``, ``output`` (the transformed text).

    ``unit`` is ``line`` (up to and with a line feed) or ``char`` (a code
    point).  The cuts, the order and whether a text is transformed at all
    follow from ``seed`` and the id alone, so reruns agree.  ``form`` is
    ``plain`` for texts that stay as they are: empty or null ones, those that
    hold a sentinel, and ``100 - rate`` percent of the others; the two sizes
    are then null.  A null id draws as an empty one; repeated rows give
    repeated results; an empty table an empty result; other columns are not
    read.  A map without shuffle.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                draws = [part.column(k + 2).to_numpy(zero_copy_only=False) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *transformed(part.column(1), draws, unit, rate, spm_rate)],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("_text"), *draws_of(id_col, seed))
    shape = f"{id_col} {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(run, shape)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that a transformed one was made of.

    Sentinels cannot lie in the text, nor across its cuts (each begins with
    its only ``<``), so the first of each kind is the one that was put in."""
    prefix, suffix, middle = SENTINELS
    whole = F.col(output)

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(whole, left, -1), right, 1)

    last = F.substring_index(whole, middle, -1)
    psm = F.concat(between(prefix, suffix), last, between(suffix, middle))
    spm = F.concat(between(prefix, middle), last, between(suffix, prefix))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(whole)


@llm_query(
    "op12_fill_in_middle",
    r"""
    WITH t AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
        FROM documents
    ), l AS (
        SELECT doc_id, text, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
               CAST('0x' || h[25:32] AS BIGINT) AS h4, string_split(text, chr(10)) AS parts,
               length(text) - length(replace(text, chr(10), ''))
                   + CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS n
        FROM t
    ), c AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM l
    ), b AS (
        SELECT doc_id, text, h4, n,
               CASE WHEN lo = 0 THEN 0 WHEN lo = n THEN length(text)
                    ELSE length(array_to_string(parts[1:lo], chr(10))) + 1 END AS x,
               CASE WHEN hi = 0 THEN 0 WHEN hi = n THEN length(text)
                    ELSE length(array_to_string(parts[1:hi], chr(10))) + 1 END AS y
        FROM c
    ), f AS (
        SELECT doc_id, text, n, x, y,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
               substr(text, 1, x) AS p, substr(text, x + 1, y - x) AS m, substr(text, y + 1) AS s
        FROM b
    )
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN x END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                       ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM f
    """,
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle forms of every whole text of ``documents``, and the texts rebuilt from them."""
    rows = fill_in_middle(scan(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )
