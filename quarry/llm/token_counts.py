"""Operator 9: token counts by a whole-token shortcut.

A sentence-piece BPE vocabulary whose pieces hold the word mark only in front
can never merge across a blank, so a text's count is the sum of the counts of
its pre-tokens.  ``prove_shortcut`` checks that property of the vocabulary and
finds, once per worker, every vocabulary string that encodes alone as exactly
one token: those pre-tokens count one each without merging.  Only the other
pre-tokens are merged, by the library itself, each distinct one once while it
stays in a bounded table.  Texts to which the proof does not apply (blanks in
a row or at an end, or a literal word mark) are encoded whole.
"""

from __future__ import annotations

import functools
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scan, slices, text_of
from quarry.llm.registry import llm_query

#: The word mark of sentence-piece vocabularies (fixed value).
MARK = "▁"
#: Pre-tokens that a worker remembers at most.
REMEMBERED = 200_000
LIMIT = 4096


@functools.lru_cache(maxsize=4)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=4)
def prove_shortcut(path: str) -> dict[str, int] | None:
    """Pre-tokens proven to be one token, or None if pieces may cross blanks."""
    sp = load(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p[1:] and p.strip(MARK) for p in pieces):
        return None
    words = [(i, p[1:]) for i, p in enumerate(pieces) if p[0] == MARK and p.strip(MARK)]
    alone = sp.encode([w for _, w in words])
    return {w: 1 for (i, w), ids in zip(words, alone, strict=True) if ids == [i]}


def divisible(text: str) -> bool:
    """Whether single blanks alone separate the pre-tokens of ``text``."""
    return not (not text or text[0] == " " or text[-1] == " " or "  " in text or MARK in text)


class Counter:
    """Token counts of texts with one vocabulary."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.sp, self.proven, self.remembered = load(path), prove_shortcut(path), remembered
        self.known = dict(self.proven or {})

    def counts(self, texts: list[str]) -> list[int]:
        easy = [self.proven is not None and divisible(t) for t in texts]
        parts = [t.split(" ") if e else [] for t, e in zip(texts, easy, strict=True)]
        seen = set(chain.from_iterable(parts))
        new = seen.difference(self.known)
        if len(self.known) + len(new) > self.remembered + len(self.proven or {}):
            self.known = dict(self.proven or {})
            new = seen.difference(self.known)
        new = list(new)
        self.known.update(zip(new, map(len, self.sp.encode(new)), strict=True))
        whole = iter(self.sp.encode([t for t, e in zip(texts, easy, strict=True) if not e]))
        known = self.known.__getitem__
        return [sum(map(known, p)) if e else len(next(whole)) for p, e in zip(parts, easy, strict=True)]


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``path`` names the vocabulary file on every worker.  No shuffle: counts
    are made where the rows lie.  Null counts as the empty text, which has 0
    bytes and 0 tokens; repeated rows give repeated results; an empty table
    gives an empty result; other columns are not read.
    """

    def run(batches):
        count = counter(path).counts
        for batch in batches:
            for part in slices(batch):
                n = pa.array(count(part.column(1).to_pylist()), pa.int64())
                size = pc.binary_length(part.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), size, n, pc.greater(n, limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("_text"))
    return rows.mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


@llm_query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` in the 32k sentence-piece vocabulary."""
    import public_tokenizers

    return token_counts(scan(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
