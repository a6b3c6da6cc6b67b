"""Operator 13: conversation repair by a grammar-compressed dynamic programme.

A conversation becomes a sequence of symbols, one per row: who speaks, and
whether the row must go (blank or a repeat) or breaks off.  The cheapest edits
that make its role initials match ``(s?(ua)+)?`` are a shortest path through a
four-state automaton, so a row is a 4 x 4 min-plus transfer matrix and a
conversation the product of its rows.  The products are shared:

* Re-Pair replaces the most frequent neighbouring symbols of all
  conversations at hand by a new symbol, again and again; each rule has one
  matrix, the product of its two parts, evaluated bottom-up;
* a matrix entry holds the least cost, its *audit* (the edits' letters) as a
  rope - the state between the two parts - and the rank of that audit among
  the entries of its row.  An audit ends with the letter of a row and has one
  such letter per row, so none is the beginning of another and ranks compose:
  ties are broken towards the least audit without ever spelling one out.

Conversations are cut into chunks (by turn range, then by rows), so a
conversation with a third of all rows is worked on by many tasks: chunks yield
matrices, a conversation of several chunks multiplies these (one small row per
chunk), and a second pass spells the edits of each chunk.  Only the SHA-256 of
a repaired conversation is sequential by nature; its rows stream through one
task, a chunk at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scan, slices
from quarry.llm.registry import llm_query
from quarry.operators.joins import bounded_broadcast
from quarry.session import materialize

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
STATES = 4
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: State after an inserted or changed row; such a row is the assistant's in state 2, else the user's.
PUT = (2, 2, 3, 2)
SPEAKER = ("user", "user", "assistant", "user")
#: Inserts that complete what ends in a state.
CLOSING = (0, 2, 1, 0)
COST_PUT, COST_DROP, COST_BROKEN = 2, 3, 1

INITIALS = "sua"
#: Symbols: two per kind of initial (sound, broken off) and one for rows that must go.
GONE = 8
TERMINALS = 9
FAR = 1 << 40

#: Turns of one block, rows and characters of one chunk.
BLOCK_SHIFT = 12
CHUNK_ROWS = 4096
CHUNK_CHARS = 8 << 20
#: Rows and characters that share a grammar.
SHARED_ROWS = 16_384
SHARED_CHARS = 16 << 20
#: A rule is made for neighbours that occur so often at least.
LEAST = 8
#: Rows up to which lists of repeated texts and of long conversations are broadcast.
BROADCAST_ROWS = 200_000


def symbol(initial: str, gone: bool, broken: bool) -> int:
    if gone:
        return GONE
    kind = INITIALS.find(initial) if initial else -1
    return 2 * (kind if kind >= 0 else 3) + broken


def row_edits(sym: int) -> list[list[tuple[int, str] | None]]:
    """Least (cost, letters) from state to state of one row, inserts before it included."""
    best: list[list[tuple[int, str] | None]] = [[None] * STATES for _ in range(STATES)]
    initial, broken = (INITIALS + "-")[sym // 2] if sym != GONE else "-", sym % 2
    for start in range(STATES):
        state, cost, letters = start, 0, ""
        for _ in range(3):
            ways = [(state, cost + COST_DROP, letters + "D")]
            if sym != GONE:
                ways.append((PUT[state], cost + COST_PUT + broken * COST_BROKEN, letters + "R"))
                if (state, initial) in KEEP:
                    ways.append((KEEP[state, initial], cost + broken * COST_BROKEN, letters + "K"))
            for end, price, text in ways:
                if best[start][end] is None or (price, text) < best[start][end]:
                    best[start][end] = (price, text)
            state, cost, letters = PUT[state], cost + COST_PUT, letters + "I"
    return best


def _terminals():
    tables = [row_edits(s) for s in range(TERMINALS)]
    cost = np.array([[[e[0] if e else FAR for e in row] for row in t] for t in tables], np.int64)
    rank = np.zeros((TERMINALS, STATES, STATES), np.int64)
    for s, t in enumerate(tables):
        for p, row in enumerate(t):
            for place, q in enumerate(sorted(range(STATES), key=lambda q: (row[q] is None, row[q] and row[q][1]))):
                rank[s, p, q] = place
    return tables, cost, rank


LEAVES, LEAF_COST, LEAF_RANK = _terminals()


def product(cost_a, rank_a, cost_b, rank_b):
    """Min-plus products of stacks of matrices: costs, ranks of the audits and the states between."""
    total = cost_a[..., :, :, None] + cost_b[..., None, :, :]  # from, between, to
    via = np.argmin(total * STATES + rank_a[..., :, :, None], axis=-2)
    cost = np.minimum(np.take_along_axis(total, via[..., None, :], -2)[..., 0, :], FAR)
    first = np.take_along_axis(rank_a, via, -1)
    second = np.take_along_axis(rank_b, via, -2)
    order = np.where(cost >= FAR, STATES * STATES, first * STATES + second)
    rank = np.argsort(np.argsort(order, axis=-1, kind="stable"), axis=-1, kind="stable")
    return cost, rank, via


class Grammar:
    """Re-Pair rules over the symbols of many conversations, with their matrices."""

    def __init__(self, sequences: list[list[int]], least: int = LEAST):
        self.rules: list[tuple[int, int]] = []
        self.ropes: dict[tuple[int, int, int], str] = {}
        self.cost, self.rank = LEAF_COST, LEAF_RANK
        self.via = np.zeros((TERMINALS, STATES, STATES), np.int64)
        marked = [np.array([*s, -1], np.int64) for s in sequences]
        line = np.concatenate(marked) if marked else np.zeros(0, np.int64)
        while len(line) > 1:
            left, right = line[:-1], line[1:]
            width = TERMINALS + len(self.rules)
            pairs = np.where((left >= 0) & (right >= 0), left * width + right, -1)
            counts = np.bincount(pairs[pairs >= 0], minlength=1)
            pair = int(np.argmax(counts))
            if counts[pair] < least:
                break
            at = np.flatnonzero(pairs == pair)
            if pair // width == pair % width:
                # In a run of equal symbols every other place begins a pair.
                begin = np.concatenate([[True], np.diff(at) != 1])
                head = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            line = line.copy()
            line[at] = width
            line = np.delete(line, at + 1)
            self.rules.append((pair // width, pair % width))
        for left, right in self.rules:
            cost, rank, via = product(self.cost[left], self.rank[left], self.cost[right], self.rank[right])
            self.cost = np.concatenate([self.cost, cost[None]])
            self.rank = np.concatenate([self.rank, rank[None]])
            self.via = np.concatenate([self.via, via[None]])
        stops = np.flatnonzero(line < 0)
        starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
        self.lines = [line[a:b] for a, b in zip(starts, stops, strict=True)]

    def audit(self, sym: int, start: int, end: int) -> str:
        """Letters of a symbol's cheapest edits between two states; spelled once."""
        key = (sym, start, end)
        text = self.ropes.get(key)
        if text is None:
            if sym < TERMINALS:
                text = LEAVES[sym][start][end][1]
            else:
                left, right = self.rules[sym - TERMINALS]
                between = int(self.via[key])
                text = self.audit(left, start, between) + self.audit(right, between, end)
            self.ropes[key] = text
        return text

    def products(self):
        """Matrix of each sequence (none of them empty), and the states between its symbols."""
        size = np.array([len(s) for s in self.lines])
        order = np.argsort(-size, kind="stable")
        first = np.array([s[0] for s in self.lines])[order] if len(order) else np.zeros(0, np.int64)
        cost, rank = self.cost[first].copy(), self.rank[first].copy()
        steps = []
        for t in range(1, int(size.max(initial=0))):
            live = int(np.count_nonzero(size > t))
            sym = np.array([self.lines[k][t] for k in order[:live]])
            c, r, via = product(cost[:live], rank[:live], self.cost[sym], self.rank[sym])
            cost[:live], rank[:live] = c, r
            steps.append(via)
        back = np.argsort(order)
        return cost[back], rank[back], steps, back

    def audits(self, steps, back, starts, ends) -> list[str]:
        """Letters of each sequence between its two states."""
        out = []
        for k, line in enumerate(self.lines):
            place, start, state, parts = back[k], int(starts[k]), int(ends[k]), []
            for t in range(len(line) - 1, 0, -1):
                between = int(steps[t - 1][place, start, state])
                parts.append(self.audit(int(line[t]), between, state))
                state = between
            parts.append(self.audit(int(line[0]), start, state))
            out.append("".join(reversed(parts)))
        return out


def finish(cost, rank) -> int:
    """Best last state, given costs and ranks of audits from the first state on."""
    totals = [(int(cost[q]) + COST_PUT * CLOSING[q], int(rank[q]), q) for q in range(STATES)]
    return min(totals)[2]


class Chunk:
    """Consecutive rows of one conversation, in order."""

    __slots__ = ("conv", "block", "number", "roles", "texts", "symbols", "chars", "turns", "stats", "last")

    def __init__(self, conv, block, number, before):
        self.conv, self.block, self.number, self.last = conv, block, number, before
        self.roles, self.texts, self.symbols, self.turns, self.chars = [], [], [], [], 0
        self.stats = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal

    def add(self, turn, role, text, later):
        row = (turn, role, text)
        repeated = later or row == self.last
        body = text.rstrip(BLANKS)
        blank = not body
        broken = not blank and body[-1] not in ENDS
        if blank:
            self.stats[0] += 1
        elif repeated:
            self.stats[1] += 1
        elif broken:
            self.stats[2] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.stats[3] += 1
        self.symbols.append(symbol(role[:1], blank or repeated, broken))
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.chars += len(text)
        self.last = row

    def rows_of(self, audit: str, state: int, closing: int = 0):
        """Repaired rows ``(role, text, edit)``."""
        at = 0
        for letter in audit:
            if letter == "I":
                yield SPEAKER[state], "", letter
                state = PUT[state]
                continue
            role, text = self.roles[at], self.texts[at]
            at += 1
            if letter == "K":
                yield role, text, letter
                state = KEEP[state, role[:1]]
            elif letter == "R":
                yield SPEAKER[state], text, letter
                state = PUT[state]
        for _ in range(closing):
            yield SPEAKER[state], "", "I"
            state = PUT[state]

    def summary(self) -> list:
        known = [t for t in self.turns if t is not None]
        span = [min(known), max(known), len(set(known))] if known else [None, None, 0]
        return [*span, self.roles[0][:1], self.roles[-1][:1], *self.stats]


def chunks_of(columns):
    """Chunks of the rows ``(conv, block, turn, role, text, later)``, which come in order."""
    chunk = None
    for conv, block, turn, role, text, later in columns:
        if chunk is None or chunk.conv != conv or chunk.block != block:
            if chunk is not None:
                yield chunk
            chunk = Chunk(conv, block, 0, None)
        elif len(chunk.symbols) >= CHUNK_ROWS or chunk.chars >= CHUNK_CHARS:
            yield chunk
            chunk = Chunk(conv, block, chunk.number + 1, chunk.last)
        chunk.add(turn, role, text, later)
    if chunk is not None:
        yield chunk


def groups_of(chunks):
    """Lists of chunks that share a grammar, bounded in rows and characters."""
    held, rows, chars = [], 0, 0
    for chunk in chunks:
        held.append(chunk)
        rows, chars = rows + len(chunk.symbols), chars + chunk.chars
        if rows >= SHARED_ROWS or chars >= SHARED_CHARS:
            yield held
            held, rows, chars = [], 0, 0
    if held:
        yield held


def rows_in(batches):
    for batch in batches:
        for part in slices(batch, 1024):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def spelled(roles_texts, digest, first: bool) -> bool:
    """Add repaired rows to a digest; returns whether nothing was added yet."""
    for role, text, _ in roles_texts:
        digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
        first = False
    return first


SUMMARY = "low long, high long, turns long, head string, tail string, blank long, duplicate long, truncated long, illegal long"
CHUNK_FIELDS = f"block long, number int, {SUMMARY}, costs array<long>, ranks array<int>, cost long, audit string, repaired_sha256 string"


def _arrow_type(kind: str) -> pa.DataType:
    simple = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
              "array<int>": pa.list_(pa.int32())}
    return simple[kind]


def _batch(rows: list[tuple], conv_type: pa.DataType, fields: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in fields.split(", ")]
    types = [_arrow_type(f.split()[1]) for f in fields.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
    arrays = [pa.array(c, t) for c, t in zip(columns, [conv_type, *types], strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["conv", *names])


def _chunk_results(batches):
    """One row per chunk: counts, matrix, and what it is if it is the whole conversation."""
    kind = None

    def source():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    for group in groups_of(chunks_of(rows_in(source()))):
        grammar = Grammar([c.symbols for c in group])
        cost, rank, steps, back = grammar.products()
        ends = [finish(cost[k, 0], rank[k, 0]) for k in range(len(group))]
        audits = grammar.audits(steps, back, [0] * len(group), ends)
        rows = []
        for k, chunk in enumerate(group):
            digest = hashlib.sha256()
            spelled(chunk.rows_of(audits[k], 0, CLOSING[ends[k]]), digest, True)
            price = int(cost[k, 0, ends[k]]) + COST_PUT * CLOSING[ends[k]]
            rows.append((
                chunk.conv, chunk.block, chunk.number, *chunk.summary(), cost[k].ravel().tolist(), rank[k].ravel().tolist(),
                price, audits[k] + "I" * CLOSING[ends[k]], digest.hexdigest(),
            ))
        yield _batch(rows, kind, CHUNK_FIELDS)


JOINED_FIELDS = f"{SUMMARY}, cost long, path string"


def _joined(batches):
    """One row per conversation of several chunks: counts, cost and the states around each chunk."""
    kind, current, state = None, None, None

    def done():
        head, summary, costs, ranks, between = state
        end = finish(costs, ranks)
        path, q = [], end
        for via in reversed(between):
            path.append(chr(65 + STATES * int(via[q]) + q))
            q = int(via[q])
        price = int(costs[end]) + COST_PUT * CLOSING[end]
        return _batch([(head, *summary, price, "".join(reversed(path)))], kind, JOINED_FIELDS)

    for batch in batches:
        kind = batch.schema.field(0).type
        for row in rows_in([batch]):
            conv, _, _, low, high, turns, head, tail, blank, duplicate, truncated, illegal, costs, ranks = row
            costs = np.array(costs, np.int64).reshape(STATES, STATES)
            ranks = np.array(ranks, np.int64).reshape(STATES, STATES)
            if current is None or conv != current[0]:
                if current is not None:
                    yield done()
                current = (conv,)
                # Before all rows: in the first state at no cost.
                start = np.array([0, FAR, FAR, FAR], np.int64), np.zeros(STATES, np.int64)
                state = [conv, [low, high, 0, head, tail, 0, 0, 0, 0], *start, []]
                joint = False
            else:
                joint = True
            summary = state[1]
            overlap = joint and low is not None and summary[1] == low
            summary[2] += turns - overlap
            if joint:
                summary[8] += summary[4] + head not in ("su", "ua", "au")
                if low is not None:
                    summary[0] = low if summary[0] is None else summary[0]
                    summary[1] = high
            summary[4] = tail
            for k, n in enumerate((blank, duplicate, truncated, illegal)):
                summary[5 + k] += n
            cost, rank, via = product(state[2][None], state[3][None], costs, ranks)
            state[2], state[3] = cost[0], rank[0]
            state[4].append(via[0].astype(np.int8))
    if current is not None:
        yield done()


def _spelled_long(batches):
    """Audit and digest of conversations of several chunks.  Each one's path comes
    first; its chunks follow in order and are worked off one group at a time."""
    kind, path, digest, first, audits, conv = None, "", None, True, [], None
    fields = "audit string, repaired_sha256 string"

    def rows():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield from rows_in([batch])

    def chunks():
        pending: list = [None]

        def plain():
            for row in source:
                if row[1] == 0:
                    pending.append(row)
                    return
                yield row[0], *row[2:]

        while True:
            yield from (("chunk", c) for c in chunks_of(plain()))
            head = pending.pop()
            if head is None:
                return
            yield "path", head

    source, stream, number = rows(), chunks(), 0
    for what, item in stream:
        if what == "path":
            if digest is not None:
                yield _batch([(conv, "".join(audits), digest.hexdigest())], kind, fields)
            conv, path, digest, first, audits, number = item[0], item[5], hashlib.sha256(), True, [], 0
            continue
        start, end = divmod(ord(path[number]) - 65, STATES)
        number += 1
        closing = CLOSING[end] if number == len(path) else 0
        grammar = Grammar([item.symbols])
        _, _, steps, back = grammar.products()
        audit = grammar.audits(steps, back, [start], [end])[0]
        first = spelled(item.rows_of(audit, start, closing), digest, first)
        audits.append(audit + "I" * closing)
    if digest is not None:
        yield _batch([(conv, "".join(audits), digest.hexdigest())], kind, fields)


def _ordered(turns: DataFrame) -> DataFrame:
    """Rows with block and mark of repeated texts: ``conv, block, turn, role, text, later``.

    A text said before in another turn is looked up in the list of such texts
    (blank ones need no mark); repeats within a turn are neighbours in order."""
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = turns.withColumn("said", F.sha2(F.col("text").cast("binary"), 256))
    spoken = said.filter(F.length(F.rtrim(F.col("text"), F.lit(BLANKS))) > 0)
    again = (
        spoken.groupBy("conv", "role", "said")
        .agg(F.min(when).alias("since"), F.max(when).alias("until"))
        .filter("since != until")
        .select(
            F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("said").alias("_said"),
            F.col("since.turn").alias("_since"),
        )
    )
    again = materialize(again)
    same = (
        F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("said") == F.col("_said"))
    )
    marked = said.join(bounded_broadcast(again, BROADCAST_ROWS), same, "left")
    later = F.col("_said").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_since"))
    block = F.shiftright("turn", BLOCK_SHIFT).alias("block")
    return marked.select("conv", block, "turn", "role", "text", later.alias("later"))


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
    ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows are taken by turn, null first; rows of one turn by role and text.
    Null roles and texts are one space; a role whose initial is not s, u or a
    is never kept as it is, and neither is an empty one.  The null
    conversation is one conversation.  ``gaps`` beyond a long are the largest
    long.  Repeated rows are duplicates.  An empty table gives an empty
    result; other columns are not read.  Turns are integers (any other type
    raises).
    """
    if dict(turns.dtypes)[turn_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{turn_col} must be an integer column")
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = _ordered(rows)
    order = ["block", "turn", "role", "text"]
    chunks = materialize(
        ordered.repartition("conv", "block")
        .sortWithinPartitions("conv", *order)
        .mapInArrow(_chunk_results, f"conv {kind}, {CHUNK_FIELDS}")
    )
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    longer = materialize(chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv"))
    results = chunks
    if not longer.isEmpty():
        several = bounded_broadcast(longer.withColumnRenamed("conv", "_conv"), BROADCAST_ROWS)
        is_long = F.col("conv").eqNullSafe(F.col("_conv"))
        parts = chunks.join(several, is_long, "left_semi").drop("cost", "audit", "repaired_sha256")
        joined = materialize(
            parts.repartition("conv")
            .sortWithinPartitions("conv", "block", "number")
            .mapInArrow(_joined, f"conv {kind}, {JOINED_FIELDS}")
        )
        texts = ordered.join(several, is_long, "left_semi").withColumn("kind", F.lit(1))
        nothing = [F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role")]
        paths = joined.select("conv", F.lit(0).alias("kind"), *nothing, F.col("path").alias("text"), F.lit(False).alias("later"))
        stream = texts.select("conv", "kind", *order, "later").unionByName(paths)
        shape = f"conv {kind}, audit string, repaired_sha256 string"
        spelled_out = (
            stream.repartition("conv").sortWithinPartitions("conv", "kind", *order).mapInArrow(_spelled_long, shape)
        )
        spelled_out = spelled_out.withColumnRenamed("conv", "_conv")
        whole = joined.join(spelled_out, F.col("conv").eqNullSafe(F.col("_conv")))
        cols = ["conv", "low", "high", "turns", *counts, "audit", "repaired_sha256"]
        results = chunks.join(several, is_long, "left_anti").select(*cols).unionByName(whole.select(*cols))
    wide = "decimal(38,0)"
    span = F.col("high").cast(wide) - F.col("low").cast(wide) + F.lit(1) - F.col("turns")
    gaps = F.coalesce(F.least(span, F.lit(2**63 - 1).cast(wide)).cast("long"), F.lit(0).cast("long"))
    return results.select(
        F.col("conv").alias(conv_col), gaps.alias("gaps"), *[F.col(c).cast("long").alias(c) for c in counts], "audit",
        "repaired_sha256",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by ``crc32(conv_id:turn) % 20``: drop, empty, strip the
    sentence ends, repeat, or give to the user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    draw = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", draw.alias("_draw"),
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).filter("_draw != 0")
    copies = F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(copies).alias("_copy")).drop("_copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage, repair, and one row for every conversation there was."""
    fixed = repair_conversations(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select("conv_id").distinct()
    both = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()

    def given(name: str, value) -> Column:
        return F.coalesce(F.col(name), F.lit(value)).alias(name)

    return both.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in zeros], given("audit", ""),
        given("repaired_sha256", nothing),
    )


@llm_query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all conversations of ``conversations`` after the contract's damage."""
    return repair_damaged(scan(spark, sf_dir, "conversations"))
