"""Operator 11: main text of web pages by union-free wrapper inference.

Pages of one host come from few templates.  A *wrapper* is a union-free
regular expression over their block-level tags: elements with fixed content,
optional ones ``?``, repeated ones ``+``, repeated groups ``(..)+`` and text
slots ``#``.  It is inferred by aligning the token streams of the host's pages
one after another:

* neighbours that repeat are folded into a repeated item or group;
* a tag mismatch is resolved by searching each side for the other's token;
  what lies between becomes optional;
* text that differs is a slot, text that is the same on all pages is template.

Only distinct skeletons (token streams without texts) and, per slot, the
number of pages and the bounds of the text digests leave the tasks; skeletons
of a host are aligned in salted buckets first, so a host with a third of all
pages is spread.  The wrapper then says which slots hold main text, and a
second pass over the pages reads these slots.
"""

from __future__ import annotations

import html
import json
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import scan, slices
from quarry.llm.registry import llm_query
from quarry.operators.joins import bounded_broadcast
from quarry.session import materialize

# Tag names and words of HTML pages.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
IN_HEAD = set("noscript template".split())
#: Elements that are never main text.
CHROME = set(
    "head title nav footer aside form script style noscript template textarea select button iframe object svg "
    "dialog menu noembed noframes".split()
)
#: Words in class, id or role that mark menus, notices, adverts, forms and comments.
CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login "
    "search sidebar complementary widget nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "share sharing social related recommended recommendations comment comments commentlist reply replies respond "
    "discussion disqus footer contentinfo header masthead toolbar hidden".split()
)
#: Of these, the words that hold even for an article or main element and what lies around it.
OWN_WORDS = set("comment comments reply replies ad ads advert advertisement sponsored promo related hidden".split())
#: Class words of a content column, used where no article or main element is.
CONTENT_WORDS = set("article articlebody post entry content story main".split())
#: Start tags that end an open paragraph are all that are not inline; these end an open element of their kind.
SIBLINGS = {
    "li": ("li", {"ul", "ol", "menu"}),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}),
    "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}),
    "option": ("option", {"select"}),
}

TAG = re.compile(
    r"<!--(?:>|->|.*?--!?>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CONCEALED = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}

#: Elements nested deeper than this count to their ancestor at this depth; their text stays.
DEPTH = 48
SALT = 32
#: Entries that a task holds before it sends them on.
HELD = 20_000
#: Rows up to which the plans of the hosts are broadcast.
BROADCAST_ROWS = 50_000


@lru_cache(maxsize=20_000)
def key_of(name: str, attributes: str) -> str:
    """Tag name with the words of its class, id, role and item property, digits left out."""
    words = [w.lower() for m in ATTRIBUTE.finditer(attributes) for w in WORDS.findall(m[2] or m[3] or m[4] or "")]
    if attributes and CONCEALED.search(attributes):
        words.append("hidden")
    return ".".join([name, *dict.fromkeys(words)])


def parse(page: str) -> tuple[list, list[tuple[str, str]]]:
    """Block-level tree ``[key, children]`` and the blocks ``(path, text)`` in page order.

    Tolerant: a paragraph ends where the next block begins, list items and
    cells where their next sibling begins, all else where an ancestor or the
    page ends.  A leaf ``#`` stands for text, ``#a`` for text wholly in links.
    """
    root = ["", []]
    # Open elements: name, path, node.  Inline elements are not in it, but for marked ones.
    stack = [("", "", root)]
    blocks: list[tuple[str, str]] = []
    buffer: list[str] = []
    links, linked, at, size = 0, True, 0, len(page)

    def flush():
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                leaf = "#a" if linked else "#"
                _, path, node = stack[-1]
                if not node[1] or node[1][-1] != leaf:
                    node[1].append(leaf)
                blocks.append((f"{path}/{leaf}", text))
        linked = True

    def close(depth: int):
        flush()
        del stack[depth:]

    def opened(names, stops) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stops:
                return 0
        return 0

    while at < size:
        tag = TAG.search(page, at)
        piece = page[at : tag.start()] if tag else page[at:]
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if not links and linked and piece.strip():
                linked = False
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if not name:
            continue
        name = name.lower()
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in ("html", "body"):
                continue
            k = opened((name,), ())
            if name not in INLINE:
                close(k or len(stack))
            elif k and k == len(stack) - 1:
                close(k)
            continue
        attributes = tag[3]
        if name in INLINE:
            if name == "br":
                buffer.append(" ")
            elif name == "a":
                links += 1
            if attributes and name not in VOID and chrome_word(key := key_of(name, attributes)):
                flush()
                push(stack, name, key)
            continue
        flush()
        if name in RAW:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            continue
        links = 0
        if stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        k = opened(("p",), ("button", "td", "th", "caption", "object", "template"))
        if k:
            close(k)
        if name in SIBLINGS:
            kin, stops = SIBLINGS[name]
            k = opened(kin.split(), stops)
            while k:
                close(k)
                k = opened(kin.split(), stops)
        if name not in ("html", "body") or not any(s[0] == name for s in stack):
            push(stack, name, key_of(name, attributes))
    flush()
    return root, blocks


def push(stack: list, name: str, key: str):
    _, path, node = stack[-1]
    if len(stack) < DEPTH:
        child = [key, []]
        node[1].append(child)
        stack.append((name, f"{path}/{key}", child))
    elif len(stack) < 4 * DEPTH:
        stack.append((name, path, node))


@lru_cache(maxsize=20_000)
def chrome_word(key: str) -> bool:
    return not CHROME_WORDS.isdisjoint(key.split(".")[1:])


# Wrappers.  An item is [key, optional, repeated, children]; a group has the key "()".


def label(item: list) -> tuple:
    return tuple(c[0] for c in item[3]) if item[0] == "()" else (item[0],)


def fold(items: list) -> list:
    """Neighbouring repeats, of one to three items, become one repeated item or group."""
    out: list = []
    for item in items:
        out.append(item)
        while shrunk(out):
            pass
    return out


def shrunk(out: list) -> bool:
    """Fold the end of ``out`` once, if it repeats what stands before it."""
    if len(out) > 1 and label(out[-2]) == label(out[-1]):
        a, b = out[-2:]
        out[-2:] = [[a[0], a[1] and b[1], True, align(a[3], b[3])]]
        return True
    for width in (2, 3):
        tail, before = out[-width:], out[-2 * width : -width]
        keys = tuple(t[0] for t in tail)
        if len(out) <= width or "()" in keys:
            continue
        group = out[-width - 1]
        if label(group) == keys:
            both = [merged(x, y) for x, y in zip(group[3], tail, strict=True)]
            out[-width - 1 :] = [["()", group[1], True, both]]
            return True
        if tuple(t[0] for t in before) == keys:
            both = [merged(x, y) for x, y in zip(before, tail, strict=True)]
            out[-2 * width :] = [["()", False, True, both]]
            return True
    return False


def merged(a: list, b: list) -> list:
    """One item for two of the same label."""
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3])]


def align(a: list, b: list) -> list:
    """The union-free expression of two item sequences.

    At a mismatch each side is searched for the other's item; the nearer one
    wins, and the items before it become optional."""
    places: list[dict[tuple, list[int]]] = []
    for side in (a, b):
        found: dict[tuple, list[int]] = {}
        for k in range(len(side) - 1, -1, -1):
            found.setdefault(label(side[k]), []).append(k)
        places.append(found)

    def ahead(side: int, key: tuple, start: int) -> int | None:
        spots = places[side].get(key, [])
        while spots and spots[-1] < start:
            spots.pop()
        return spots[-1] if spots else None

    out: list = []
    i = j = 0
    while i < len(a) and j < len(b):
        if label(a[i]) == label(b[j]):
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = ahead(1, label(a[i]), j), ahead(0, label(b[j]), i)
        if in_b is not None and (in_a is None or in_b - j <= in_a - i):
            out += [optional(x) for x in b[j:in_b]]
            j = in_b
        elif in_a is not None:
            out += [optional(x) for x in a[i:in_a]]
            i = in_a
        else:
            out += [optional(a[i]), optional(b[j])]
            i, j = i + 1, j + 1
    out += [optional(x) for x in a[i:]] + [optional(x) for x in b[j:]]
    return fold(out)


def optional(item: list) -> list:
    return [item[0], True, item[2], item[3]]


def skeleton(node) -> list:
    """A page's own wrapper: its block-level tree with repeats folded."""
    if isinstance(node, str):
        return [node, False, False, []]
    return [node[0], False, False, fold([skeleton(c) for c in node[1]])]


def expression(item: list) -> str:
    """The wrapper as text: ``key(content)`` with ``?``, ``+`` or ``*``."""
    body = " ".join(expression(c) for c in item[3])
    shown = f"({body})" if item[0] == "()" else item[0] + (f"({body})" if body else "")
    return shown + ("*" if item[1] and item[2] else "?" if item[1] else "+" if item[2] else "")


def dumped(item: list) -> str:
    return json.dumps(item, ensure_ascii=False, separators=(",", ":"))


def slots(item: list, path: str = "") -> list[str]:
    """Paths of all text slots of a wrapper."""
    if item[0] == "()":
        return [s for c in item[3] for s in slots(c, path)]
    if item[0] in ("#", "#a"):
        return [f"{path}/{item[0]}"]
    here = f"{path}/{item[0]}" if item[0] else path
    return [s for c in item[3] for s in slots(c, here)]


def plan(wrapper: list, constant: set[str]) -> list[list[str]]:
    """Slot paths of main text, by decreasing preference: inside articles, inside main
    elements, inside either of them under a misnamed layout element, in a content
    column, text that differs between pages and is not a link, and at last all
    that no tag or class name marks as something else."""
    paths = sorted(set(slots(wrapper)))
    parts = {p: p.split("/")[1:] for p in paths}

    def own(key: str) -> bool:
        return OWN_WORDS.isdisjoint(key.split(".")[1:])

    def body(key: str) -> bool:
        return key.split(".")[0] in ("article", "main") and own(key)

    # Layout elements around an article or main element, which their class words may misname.
    around = {tuple(keys[:k]) for keys in parts.values() for k in range(len(keys)) if body(keys[k])}

    def clean(path: str, spared: bool) -> bool:
        keys, inside = parts[path], False
        for k, key in enumerate(keys[:-1]):
            name, *words = key.split(".")
            holds = spared and own(key) and tuple(keys[: k + 1]) in around
            if name in CHROME and not (name == "form" and holds):
                return False
            if body(key):
                inside = True
            elif name in ("article", "main"):
                return False
            elif name in ("html", "body") or holds:
                continue
            elif name == "header" and not inside:
                return False
            elif not (CHROME_WORDS - {"header"} if inside else CHROME_WORDS).isdisjoint(words):
                return False
        return True

    def under(some: list[str], test) -> list[str]:
        return [p for p in some if any(map(test, parts[p][:-1]))]

    def is_a(*names: str):
        return lambda key: key.split(".")[0] in names

    kept = [p for p in paths if clean(p, False)]
    return [
        under(kept, is_a("article")),
        under(kept, is_a("main")),
        under([p for p in paths if clean(p, True)], is_a("article", "main")),
        under(kept, lambda key: not CONTENT_WORDS.isdisjoint(key.split(".")[1:])),
        [p for p in kept if p not in constant and not p.endswith("/#a")],
        kept,
    ]


def host_of(url_col: str) -> Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    host = F.regexp_extract(F.col(url_col), r"^[^/?#]*//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(host, F.lit("")))


EVIDENCE = "host string, kind string, what string, pages long, low long, high long"


def _evidence(batches):
    """Distinct skeletons and slots of a task, with page counts and digest bounds."""
    held: dict[tuple, list[int]] = {}

    def sent():
        rows = [(*k, *v) for k, v in held.items()]
        held.clear()
        names = ["host", "kind", "what", "pages", "low", "high"]
        types = [pa.string()] * 3 + [pa.int64()] * 3
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def note(key, low, high):
        entry = held.get(key)
        if entry is None:
            held[key] = [1, low, high]
        else:
            entry[0] += 1
            entry[1], entry[2] = min(entry[1], low), max(entry[2], high)

    for batch in batches:
        for part in slices(batch):
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tree, blocks = parse(page)
                note((host, "skeleton", dumped(skeleton(tree))), 0, 0)
                seen: dict[str, list[int]] = {}
                for path, text in blocks:
                    seen.setdefault(path, []).append(xxhash.xxh64_intdigest(text) >> 1)
                for path, digests in seen.items():
                    note((host, "slot", path), min(digests), max(digests))
                if len(held) >= HELD:
                    yield sent()
    yield sent()


def _aligned(keys: int):
    """Fold wrappers that come sorted by their first ``keys`` columns; holds one wrapper."""

    def run(batches):
        current, wrapper = None, None
        shape = ["host", "bucket"][:keys]

        def done():
            values = [*current, dumped(wrapper)]
            kinds = [pa.string(), pa.int32()][:keys] + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[*shape, "wrapper"]
            )

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                item = json.loads(row[-1])
                if row[:keys] == current:
                    wrapper = merged(wrapper, item)
                else:
                    if current is not None:
                        yield done()
                    current, wrapper = row[:keys], item
        if current is not None:
            yield done()

    return run


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: ``host``, ``wrapper`` (JSON of the items), ``expression`` (readable),
    ``constant`` (paths whose text is the same on all of at least two pages).

    All pages take part.  Skeletons are aligned in the order of their text, in
    ``SALT`` buckets per host and then across the buckets, so the result does
    not depend on how the pages are laid out."""
    rows = pages.select(host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    evidence = materialize(
        rows.mapInArrow(_evidence, EVIDENCE)
        .groupBy("host", "kind", "what")
        .agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    skeletons = evidence.filter("kind = 'skeleton'").select(
        "host", F.pmod(F.hash("what"), F.lit(SALT)).alias("bucket"), F.col("what").alias("wrapper")
    )
    salted = (
        skeletons.repartition("host", "bucket")
        .sortWithinPartitions("host", "bucket", "wrapper")
        .mapInArrow(_aligned(2), "host string, bucket int, wrapper string")
    )
    whole = (
        salted.repartition("host")
        .sortWithinPartitions("host", "bucket")
        .select("host", "wrapper")
        .mapInArrow(_aligned(1), "host string, wrapper string")
    )
    fixed = (
        evidence.filter("kind = 'slot' AND pages > 1 AND low = high")
        .groupBy("host")
        .agg(F.array_sort(F.collect_set("what")).alias("constant"))
    )
    joined = whole.join(fixed, "host", "left")
    spoken = F.coalesce("constant", F.array().cast("array<string>")).alias("constant")
    return joined.select("host", "wrapper", spoken).mapInArrow(
        _spoken, "host string, wrapper string, expression string, constant array<string>, plan string"
    )


def _spoken(batches):
    for batch in batches:
        hosts, wrappers, constants = (c.to_pylist() for c in batch.columns)
        items = [json.loads(w) for w in wrappers]
        plans = [dumped(plan(w, set(c))) for w, c in zip(items, constants, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([expression(w).strip() for w in items], pa.string()),
             batch.column(2), pa.array(plans, pa.string())],
            names=["host", "wrapper", "expression", "constant", "plan"],
        )


@lru_cache(maxsize=2_000)
def levels(text: str) -> list[set[str]]:
    return [set(paths) for paths in json.loads(text)]


def main_text(page: str, plan_text: str | None) -> str:
    """Blocks of the most preferred slots in which the page has text, one per line."""
    _, blocks = parse(page)
    for paths in levels(plan_text or "[]"):
        found = [text for path, text in blocks if path in paths]
        if found:
            return "\n".join(found)
    return ""


def _extracted(id_col: str, url_col: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                pairs = zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                texts = [main_text(page, plan_text) for page, plan_text in pairs]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"],
                )

    return run


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: id, url, ``text`` (blocks of main text, one per line), ``n_chars``.

    Null or empty html gives the empty text; a null or malformed url belongs
    to the host without a name; repeated rows give repeated results; an empty
    table an empty result; other columns are not read.  Character references
    are decoded, each run of white space (any Unicode one, and ``br``) in a
    block becomes one space.  The plans of the hosts are broadcast under a
    checked bound; beyond it the pages are joined with them by host, where
    adaptive execution splits a hot host.
    """
    if url_col in ("host", "plan") or id_col in ("host", "plan"):
        pages = pages.withColumnsRenamed({"host": "_host_", "plan": "_plan_"})
        renamed = {"host": "_host_", "plan": "_plan_"}
        out = extract_main_text(pages, renamed.get(id_col, id_col), renamed.get(url_col, url_col), html_col)
        return out.toDF(id_col, url_col, "text", "n_chars")
    wrappers = materialize(infer_wrappers(pages, url_col, html_col)).select("host", "plan")
    rows = pages.select(
        F.col(id_col).alias(id_col), F.col(url_col).alias(url_col),
        F.coalesce(F.col(html_col), F.lit("")).alias("_page"), host_of(url_col).alias("host"),
    )
    planned = rows.join(bounded_broadcast(wrappers, BROADCAST_ROWS), "host", "left")
    kind = pages.schema[id_col].dataType.simpleString()
    shape = f"{id_col} {kind}, {url_col} string, text string, n_chars long"
    return planned.select(id_col, url_col, "_page", "plan").mapInArrow(_extracted(id_col, url_col), shape)


@llm_query("op11_html_extraction")
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return extract_main_text(scan(spark, sf_dir, "pages"))
