"""Fixtures of the training-data operators: every odd case in one small table."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"w{k * 7919 % 9973}" for k in range(160))
LONG = " ".join(f"v{k * 104729 % 999983}" for k in range(30_000))
ODD = [
    (0, None, "en", "a", None),
    (1, "", None, "a", 0),
    (2, " \t\n ", "en", None, 4),
    (3, LONG, "en", "b", len(LONG)),
    (4, PROSE, "en", "b", len(PROSE)),
    (5, PROSE.replace(" ", "  "), "en", "c", 1),
    (6, PROSE + " end", "en", "c", 1),
    (6, PROSE + " end", "en", "c", 1),  # a repeated row
    (7, "token = \"0123456789abcdef0123456789abcdef\" \U0001F600 x", "en", "a", 1),
    (8, "café ▁ <|endoftext|> 中文 </s>", "zh", "a", 1),
    (9, "one two", "en", "", 7),
    (10, "ONE  two", "en", "", 8),
    (None, "a row without an id", "en", "d", 1),
    (None, PROSE, "en", "d", 1),
]


def odd_table(spark):
    """The odd rows, with columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, SCHEMA)
    names = "_text _key _source _size _q id node component keep_id length score _sig _base spans _text_key _row u v"
    names += " _ruled _ruled_text _gone _digest _pos _id _wanted _kept _n _class _words _rows _p _cell _h1 _line output form"
    return df.withColumns({n: F.lit(n) for n in dict.fromkeys(names.split())})


def empty_table(spark):
    return odd_table(spark).limit(0)


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)
