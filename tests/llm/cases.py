"""Rows that every operator has to take: nulls, empty, odd and long texts, repeats and clashing columns."""

import math

TEXTS = [
    None, "", " ", "\n\t ", "a", "Hello  world\n\n x ", "café 北京 <|endoftext|> done", "y" * 20_000, "emoji 👩‍👩‍👧 é ͸ \U00016ac0 क्षि",
    "tabs\t\tand   nbsp   em end", "don't I'LL 123abc_..!! we've", "same text here", "same text here", "\x00 nul \x1f \x7f", "one two", "ONE two",
    "<|endoftext|>", " lead and trail ", "word " * 4_000, " private  ", "a\r\nb \r\n  c",
]

#: Names that operators use themselves, as further columns.
EXTRA = ["id", "n", "key", "node", "size", "part", "chunk", "words", "copies", "__id", "__near", "__clean", "v", "grade"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts=TEXTS, extra=False, ids=None, sources=("web", "books", None)):
    """A table like ``documents`` over the texts."""
    ids = list(range(1, len(texts) + 1)) if ids is None else ids
    rows = [(i, t, "en", sources[k % len(sources)], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    schema = SCHEMA
    if extra:
        rows = [(*r, *["clash"] * len(EXTRA)) for r in rows]
        schema += "".join(f", {c} string" for c in EXTRA)
    return spark.createDataFrame(rows, schema)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows_of(df, *columns):
    """Sorted rows as tuples; null first."""
    columns = columns or df.columns
    found = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    return sorted(found, key=lambda r: [(x is not None, "nan" if isinstance(x, float) and math.isnan(x) else x) if not isinstance(x, (list, dict)) else (True, str(x)) for x in r])
