"""Secret scans with DataFrame expressions alone.

Three base patterns and a sliding-window Shannon entropy over candidate strings
give spans ``(kind, start, end)`` in code points, end exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import as_row

#: Base kinds in their order, with pattern and the least length of a match (assign: of its second group).
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "entropy")
#: The entropy method looks at long runs of these characters, in windows of this many.
CANDIDATE, CANDIDATE_LEAST = "[A-Za-z0-9+/_=-]", 24
WINDOW = 20
#: Character classes in their order, the first that a candidate fits: pattern, and the least bits of its best window.
CLASSES = (
    ("digits", "[0-9]+", 3.1),
    ("hexadecimal", "[0-9a-f]+|[0-9A-F]+", 3.0),
    ("letters", "[A-Za-z]+", 4.0),
    ("alphanumeric", "[A-Za-z0-9]+", 3.7),
    ("base64", "[A-Za-z0-9+/]+=*|[A-Za-z0-9_-]+=*", 3.8),
    ("symbols", f"{CANDIDATE}+", 3.9),
)
#: Parts of a run that are no secrets and end a candidate: UUIDs, placeholders, repeated or counted characters.
ALLOWED = (
    "(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",
    "(?i:example|placeholder|changeme|your[_-]|xxxx)",
    "(.)\\1{7,}",
    "0123456789|abcdefghij",
)
#: Private code points that mark matches; in texts another one takes their place, which no pattern matches either.
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"
#: Places of one block of a running total, and characters of a chunk of text that spans are cut from.
BLOCK, CHUNK = 128, 4_096


def marked(text: Column, pattern: str) -> Column:
    """``text`` with a mark before and behind each leftmost non-overlapping match."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place of a bound array of numbers, ``merge`` over all places before it, from 0.

    Blocks of ``BLOCK`` places are merged first, so that a place looks at its own
    block and the blocks before it and not at every place.
    """
    zero = F.lit(0)

    def over(array: Column, begin: Column, count: Column) -> Column:
        return F.aggregate(F.slice(array, begin.cast("int"), count.cast("int")), zero, merge)

    def placed(before: Column) -> Column:
        at = lambda i: F.floor(i / BLOCK).cast("int")
        return F.transform(values, lambda _, i: merge(F.get(before, at(i)), over(values, at(i) * BLOCK + 1, i % BLOCK)))

    blocks = F.transform(F.sequence(zero, F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: over(values, b * BLOCK + 1, F.lit(BLOCK)))
    before = bound(blocks, lambda x: F.transform(x, lambda _, b: over(x, F.lit(1), b)))
    return F.when(F.size(values) > 0, bound(before, placed)).otherwise(F.array().cast("array<int>"))


def cut(column: Column) -> Column:
    """``(at, part, inside)`` of the parts of a marked string in turn: where each begins without the marks, and whether it is a match."""

    def of_parts(parts: Column) -> Column:
        starts = bound(F.transform(parts, lambda p: F.length(p)), lambda n: running(n, lambda x, y: x + y))
        return bound(starts, lambda at: F.transform(parts, lambda p, i: F.struct(F.get(at, i).alias("at"), p.alias("part"), (i % 2 == 1).alias("inside"))))

    return bound(F.split(column, f"[{OPEN}{CLOSE}]"), of_parts)


def span(rank: int, at: Column, part: Column) -> Column:
    return F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(part)).alias("stop"), F.lit(KINDS[rank]).alias("kind"))


def spans_of(column: Column, rank: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the marked matches that ``keep`` accepts, in order."""
    kept = F.filter(cut(column), lambda x: x["inside"] & keep(x["part"]))
    return F.when(F.contains(column, F.lit(OPEN)), F.transform(kept, lambda x: span(rank, x["at"], x["part"]))).otherwise(F.array().cast(SPAN))


def random_spans(column: Column, rank: int) -> Column:
    """Spans of the candidates in the marked runs: what allow-list parts leave of a run, where its class's entropy is reached."""
    allowed = "|".join(ALLOWED)

    def of_run(run: Column) -> Column:
        pieces = F.filter(cut(marked(run["part"], allowed)), lambda x: ~x["inside"] & is_random(x["part"]))
        return F.transform(pieces, lambda x: span(rank, run["at"] + x["at"], x["part"]))

    found = F.flatten(F.transform(F.filter(cut(column), lambda x: x["inside"]), of_run))
    return F.when(F.contains(column, F.lit(OPEN)), found).otherwise(F.array().cast(SPAN))


def entropy_peak(candidate: Column, window: int = WINDOW) -> Column:
    """The highest entropy in bits of any window of an ASCII string of at least ``window`` characters.

    Sliding by one character lowers the count of the one that leaves and raises
    that of the one that enters, so the sum of ``n * log2(n)`` is carried on rather
    than summed anew. The state holds the window itself, whatever the string's length.
    """
    weights = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)))
    start = F.struct(F.lit("").alias("held"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))

    def count(held: Column, character: Column) -> Column:
        return F.length(held) - F.length(F.replace(held, character, F.lit("")))

    def without_first(state: Column) -> Column:
        n = count(state["held"], F.substr(state["held"], F.lit(1), F.lit(1)))
        shorter = F.struct(F.substr(state["held"], F.lit(2)).alias("held"), (state["total"] + F.get(weights, n - 1) - F.get(weights, n)).alias("total"), state["least"].alias("least"))
        return F.when(F.length(state["held"]) == window, shorter).otherwise(state)

    def slide(state: Column, character: Column) -> Column:
        def entered(s: Column) -> Column:
            n = count(s["held"], character)
            held, total = F.concat(s["held"], character), s["total"] + F.get(weights, n + 1) - F.get(weights, n)
            return F.struct(held.alias("held"), total.alias("total"), F.when(F.length(held) == window, F.least(s["least"], total)).otherwise(s["least"]).alias("least"))

        return bound(without_first(state), entered)

    least = F.aggregate(F.split(candidate, ""), start, slide, lambda s: s["least"])
    return F.lit(math.log2(window)) - least / window


def is_random(candidate: Column) -> Column:
    """Whether a candidate string is long enough and reaches the entropy of its class."""
    bits = F.lit(None)
    for _, pattern, least in reversed(CLASSES):
        bits = F.when(F.rlike(candidate, F.lit(f"^(?:{pattern})$")), F.lit(least)).otherwise(bits)
    return F.when(F.length(candidate) >= CANDIDATE_LEAST, entropy_peak(candidate) >= bits).otherwise(F.lit(False))


def within(spans: Column, e: Column) -> Column:
    """Whether ``e`` lies in one of ``spans``, which are in order and don't overlap: only the last that begins before it can hold it."""

    def narrower(s: Column, _: Column) -> Column:
        def halved(middle: Column) -> Column:
            before = F.get(spans, middle)["start"] <= e["start"]
            return F.struct(F.when(before, middle + 1).otherwise(s["low"]).alias("low"), F.when(before, s["high"]).otherwise(middle).alias("high"))

        return F.when(s["low"] < s["high"], bound(F.floor((s["low"] + s["high"]) / 2).cast("int"), halved)).otherwise(s)

    # 32 halvings, as a text has less than 2**31 characters
    last = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), narrower, lambda s: s["low"] - 1)
    return bound(last, lambda i: (i >= 0) & (e["stop"] <= F.get(spans, F.greatest(i, F.lit(0)))["stop"]))


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(row, base, spans)``: each row of ``docs`` as a struct, its base spans and all its spans, both by start and kind.

    Null text has none. No row moves: one pass without a shuffle.
    """
    t = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    clean = F.when(F.rlike(t, F.lit(f"[{OPEN}{CLOSE}]")), F.translate(t, OPEN + CLOSE, OTHER + OTHER)).otherwise(t)
    step = as_row(docs).select("row", clean.alias("clean"))
    step = step.select(
        "row",
        marked(F.col("clean"), ASSIGN).alias("assign"),
        marked(F.col("clean"), ACCESS).alias("access"),
        marked(F.col("clean"), f"[0-9a-f]{{{HEX_LEAST},}}").alias("hex"),
        marked(F.col("clean"), f"(?<!{CANDIDATE}){CANDIDATE}{{{CANDIDATE_LEAST},}}").alias("entropy"),
    )
    step = step.select(
        "row",
        spans_of(F.col("assign"), 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST).alias("assign"),
        spans_of(F.col("access"), 1, lambda m: F.length(m) >= ACCESS_LEAST).alias("access"),
        spans_of(F.col("hex"), 2, lambda m: F.length(m) >= HEX_LEAST).alias("hex"),
        random_spans(F.col("entropy"), 3).alias("entropy"),
    )
    fresh = F.filter("entropy", lambda e: ~(within(F.col("assign"), e) | within(F.col("access"), e) | within(F.col("hex"), e)))
    fresh = F.when(F.size("entropy") > 0, fresh).otherwise(F.col("entropy"))
    step = step.select("row", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), fresh.alias("fresh"))
    return step.select("row", "base", F.array_sort(F.concat("base", "fresh")).alias("spans"))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row.

    Null and empty texts have no spans (the hash is that of an empty string); null
    ids and repeated rows are kept row by row; an empty table gives no rows; texts
    are scanned whole, in time that grows with their length but not with its square.
    """
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return with_spans(picked).select(
        "row.doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark``; all rows and columns stay.

    ``length_col`` names a column that takes the new number of characters of changed texts.
    """
    text = F.col(f"row.`{text_col}`")

    def between(chunks: Column, begin: Column, end: Column) -> Column:
        """The characters from ``begin`` to ``end``, from the chunks that hold them."""
        first, last = F.floor(begin / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        return F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), begin % CHUNK + 1, end - begin)

    def pieces(chunks: Column) -> Column:
        def of_ends(ends: Column) -> Column:
            """``ends``: where the spans before each one end."""

            def piece(s: Column, i: Column) -> Column:
                at = F.get(ends, i)
                apart = (s["start"] > at) | (i == 0)
                return F.when(apart, F.concat(between(chunks, at, F.greatest(s["start"], at)), F.lit(mark))).otherwise(F.lit(""))

            tail = bound(F.greatest(F.element_at(ends, -1), F.element_at("spans", -1)["stop"]), lambda at: between(chunks, at, F.length(text)))
            return F.concat(F.array_join(F.transform("spans", piece), ""), tail)

        stops = bound(F.transform("spans", lambda s: s["stop"]), lambda x: running(x, lambda a, b: F.greatest(a, b)))
        return bound(stops, of_ends)

    cut_text = bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), pieces)
    shown = with_spans(docs, text_col).select("row", "spans", F.when(F.size("spans") > 0, cut_text).otherwise(text).alias("shown"))

    def column(name: str) -> Column:
        own = F.col(f"row.`{name}`")
        if name == length_col:
            own = F.when(F.size("spans") > 0, F.length("shown").cast(docs.schema[name].dataType)).otherwise(own)
        return (F.col("shown") if name == text_col else own).alias(name)

    return shown.select(*map(column, docs.columns))
