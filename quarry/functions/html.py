"""HTML paragraph text (H1) as column expressions.

Contract: a page is read as a sequence of tokens - comments (one that is not
closed runs to the end), ``<script>`` and ``<style>`` elements with all that
they hold, tags (a quoted attribute value may hold anything, an unfinished tag
runs to the end) and text, in which a ``<`` that begins none of these is
itself.  A paragraph starts at a ``<p`` tag and runs to the next ``</p`` tag,
the next paragraph start, or the end (HTML-5 style implicit close, so a ``<p>``
inside an unclosed one is not read twice).  Tags inside are dropped, character
references are decoded once by the standard's rules (also those without
semicolon, and the code points that stand for Windows characters), and
paragraphs are joined without a separator.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# What follows a tag's name: values in quotes are taken whole; none of it is tried twice.
_REST = r"""(?:[^>=]|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+"""
PARAGRAPH = rf"</?p(?:[\s/]{_REST})?+>"
LONE = r"<(?![a-zA-Z!?/])"
TOKENS = "(?is)" + "|".join([
    rf"({PARAGRAPH})",
    r"<!--.*?(?:-->|\z)",
    *(rf"<{raw}(?:[\s/]{_REST})?+>.*?(?:</{raw}(?:[\s/][^>]*)?>|\z)" for raw in ("script", "style")),
    rf"</?[a-z][^\s/>]*+{_REST}(?:>|\z)",
    r"<[!?/][^>]*(?:>|\z)",
])
PARA_START = rf"(?is)<p(?:[\s/]{_REST})?+>"
PARA_END = r"(?i)</p[\s/>]"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)"
#: Names that need no semicolon have two to so many letters.
SHORT_NAME = max(len(k) for k in html5 if not k.endswith(";"))


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _names(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _windows() -> dict[str, str]:
    """Code points 128 to 159, which stand for the characters of the Windows code page."""
    return {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


def _code_point(n: Column) -> Column:
    """The character of a code point: U+FFFD for none, a surrogate or one out of range,
    nothing for one that the standard calls invalid."""
    bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    nothing = (
        n.between(1, 8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF)
        | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    point = F.when(bad, 0xFFFD).otherwise(n)
    char = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    windows = F.element_at(_names(_windows()), n.cast("string"))
    return F.when(n.between(0x80, 0x9F), windows).when(~bad & nothing, "").otherwise(char)


def unescape(col: Column) -> Column:
    """Decode the character references of a string in one pass; unknown names stay."""
    named = _names(dict(html5))

    def number(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
        # Eight digits or more are beyond all code points.
        known = F.when(F.length(digits) < 8, F.when(digits == "", "0").otherwise(digits))
        return F.when(ref.rlike("^&#[xX]"), F.conv(known, 16, 10)).otherwise(known).cast("bigint")

    def name(ref: Column) -> Column:
        body = F.substring(ref, 2, 40)
        cuts = [F.element_at(named, body)]
        for n in range(SHORT_NAME, 1, -1):
            # The longest beginning that is a name of its own; what follows is text.
            value = F.when(F.length(body) >= n, F.element_at(named, F.substring(body, 1, n)))
            cuts.append(F.concat(value, F.substring(body, n + 1, 40)))
        return F.coalesce(*cuts, ref)

    def one(ref: Column) -> Column:
        return F.when(F.startswith(ref, F.lit("&#")), _code_point(number(ref))).otherwise(name(ref))

    gaps, refs = F.split(col, REFERENCE, -1), F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0))
    texts = F.transform(refs, one)
    woven = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(texts, i), F.lit(""))))
    return F.when(F.contains(col, F.lit("&")), F.array_join(woven, "")).otherwise(col)


def paragraph_list(col: str | Column) -> Column:
    """``array<string>``: the text of each paragraph, in document order."""
    # A lone "<" is written as a reference first: no tag can arise when others are dropped.
    bare = F.regexp_replace(F.regexp_replace(_c(col), LONE, "&lt;"), TOKENS, "$1")
    pieces = F.split(bare, PARA_START, -1)
    bodies = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(bodies, lambda p: unescape(F.split(p, PARA_END, 2)[0]))


def paragraph_text(col: str | Column) -> Column:
    """All paragraph texts joined with ``''``."""
    return F.array_join(paragraph_list(col), "")


# Fixed values of the SQL twin, which states the contract for pages without quoted
# ">" and with these references only: references that occur in the supplied pages.
DROP_BLOCKS = r"(?is)<!--.*?-->|<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>"
SIMPLE_START = r"(?i)<p([\s>/])"
MARK = "\u0001"
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]


def sql_paragraph_text(col: str) -> str:
    inner = (
        "regexp_replace(string_split_regex(regexp_replace(p, '^[^>]*>', ''), '(?i)</p[\\s>]')[1], "
        "'<[^>]*>', '', 'g')"
    )
    for ent, ch in ENTITIES:
        q = ch.replace("'", "''")
        inner = f"replace({inner}, '{ent}', '{q}')"
    marked = (
        f"regexp_replace(regexp_replace({col}, '{DROP_BLOCKS}', '', 'g'), "
        f"'{SIMPLE_START}', '{MARK}\\1', 'g')"
    )
    return (
        f"array_to_string(list_transform((string_split({marked}, '{MARK}'))[2:], "
        f"lambda p: {inner}), '')"
    )
