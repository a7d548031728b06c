"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; its documents' copies are the target's share
of the source's size. The fractional parts are rounded in pairs: mass moves
between two documents, in a random direction that keeps both expectations, until
one is integral, and the pair's words stay as they were. Groups of a source's
documents do so side by side and hand on one unfinished document each, which a
tree of further groups pairs, down to one for each source.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import as_row, materialize, numbered

#: Production parameters: weights that repeat over the sources in code-point order, share of all words, most copies.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
SEED = 20
#: Documents of more than this part of their source's words are rounded first.
LARGE = 64
#: Documents in a group at the first level, and groups that meet at the next.
GROUP, FAN_IN = 5_000, 64


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0)."""
    t = F.coalesce(text, F.lit(""))
    one = F.regexp_replace(t, "[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")
    return F.when(F.rlike(t, F.lit("[^\\x20\\x09-\\x0D]")), F.length(one)).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: Iterable[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from rows of ``(source, size)``.

    All targets add up to ``share`` of all words and stand as the weights, but none
    passes ``most`` times its source's size: such sources stop there, and the others
    share what is left by weight, until none is above. The loop carries two sums.
    """
    weights = list(weights)
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("top")), "sources")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while True:
        capped = F.col("top") <= F.col("weight") * rate
        s = table.agg(F.sum(F.when(capped, F.col("top"))), F.sum(F.when(~capped, F.col("weight")))).first()
        left, open_weight = budget - (s[0] or 0.0), s[1] or 0.0
        new = left / open_weight if open_weight else rate
        if new <= rate:
            break
        rate = new
    return table.select("source", "source_size", F.least(F.col("top"), F.col("weight") * rate).alias("target"))


def draw(seed: int, a: object, b: object) -> float:
    """A number in [0, 1) that depends on the seed and two ids alone."""
    return xxhash.xxh3_64_intdigest(f"{seed}|{a}|{b}") / 2.0**64


def pair_off(units: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """Round units of (id, words, fraction) in turn; the finished (id, words, 0 or 1) and the unfinished one."""
    done, held = [], None
    for unit in units:
        if held is None:
            held = unit
            continue
        (i, s, p), (j, t, q) = held, unit
        up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
        if draw(seed, i, j) * (up + down) < down:
            p, q = (1.0 if up == (1 - p) * s else p + up / s), (0.0 if up == q * t else q - up / t)
        else:
            p, q = (0.0 if down == p * s else p - down / s), (1.0 if down == (1 - q) * t else q + down / t)
        held = None
        for x in ((i, s, p), (j, t, q)):
            if x[2] <= 0.0 or x[2] >= 1.0:
                done.append((x[0], x[1], 1.0 if x[2] >= 1.0 else 0.0))
            else:
                held = x
    return done, held


def settle_large(units: DataFrame, seed: int, large: int) -> tuple[DataFrame, DataFrame]:
    """Round each source's largest documents against all that is left of the source.

    A document of more than ``1 / large`` of its source's words would leave a large
    rest when it meets single small ones. So the largest, in turn, go up or down at
    random, and all documents still open give or take the difference in proportion,
    which keeps words, and expectations where both directions are open; where the rest of
    a source can take the difference in one direction only, that one is taken. Fewer than ``large`` rows of a source are
    that large. Returns the settled rows with ``up``, and the open ones with their new fraction.
    """
    kind = units.schema["id"].dataType.simpleString()
    sums = units.groupBy("source").agg(F.sum("words").alias("all_words")).withColumnRenamed("source", "__s")
    big = units.join(sums, F.col("source").eqNullSafe(F.col("__s"))).where(F.col("words") * large > F.col("all_words"))

    def settle(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("words", "id"))), key=lambda r: (-r[0], str(r[1])))
        source, left, g = table.column("source")[0].as_py(), table.column("all_words")[0].as_py(), table.column("fraction")[0].as_py()
        out = []
        for words, i in rows:
            rest = left - words
            can_up, can_down = g * rest >= (1 - g) * words, (1 - g) * rest >= g * words
            if 0 < g < 1 and (can_up or can_down):
                up = draw(seed, i, "large") < g if can_up and can_down else can_up
                g, left = min(1.0, max(0.0, g - (1 - g) * words / rest if up else g + g * words / rest)), rest
                out.append((source, i, words, int(up)))
            else:
                out.append((source, i, words, None))
        names = ["source", "id", "words"]
        kinds = [table.schema.field(c).type for c in names] + [pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)] + [pa.array([g] * len(out), pa.float64())], names=[*names, "up", "g"])

    picked = big.select("source", "id", "words", "fraction", "all_words")
    done = materialize(picked.groupBy("source").applyInArrow(settle, f"source string, id {kind}, words long, up int, g double"), "large")
    settled = done.where("up is not null").select("source", "id", "words", "up")
    gone = settled.select(F.col("source").alias("__s"), F.col("id").alias("__i"), F.col("words").alias("__w"))
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("id").eqNullSafe(F.col("__i")) & (F.col("words") == F.col("__w"))
    new = done.groupBy(F.col("source").alias("__s")).agg(F.first("g").alias("g"))
    rest = units.join(gone, same, "left_anti").join(new, F.col("source").eqNullSafe(F.col("__s")), "left")
    return settled, materialize(rest.select("source", "id", "words", F.coalesce("g", "fraction").alias("fraction")), "rest")


def round_fractions(units: DataFrame, seed: int = SEED, group: int = GROUP, fan_in: int = FAN_IN, large: int = LARGE) -> DataFrame:
    """``(source, id, words, up)`` for rows of ``(source, id, words, fraction)`` with words > 0 and 0 < fraction < 1.

    All rows of a source have one fraction. The last residual of a source goes to the nearer whole number. A source's sum of words times ``up`` (0 or
    1) misses that of words times fraction by at most half the words of one document,
    which isn't one of its largest unless it has few.
    """
    kind = units.schema["id"].dataType.simpleString()
    settled, units = settle_large(units, seed, large)
    finished = [settled, units.where("fraction <= 0 or fraction >= 1").select("source", "id", "words", (F.col("fraction") >= 1).cast("int").alias("up"))]
    units = units.where("fraction > 0 and fraction < 1")
    counts = units.groupBy("source").agg(F.ceil(F.count("*") / F.lit(group)).alias("groups"))
    paired = units.join(counts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    level = paired.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id", "words"), F.col("groups"))).drop("groups")
    most = counts.agg(F.max("groups")).first()[0] or 0
    while most:
        last = most == 1

        def rounded(table: pa.Table) -> pa.Table:
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("words", "id", "fraction"))), key=lambda r: (-r[0], str(r[1]), r[2]))
            done, held = pair_off([(i, w, f) for w, i, f in rows], seed)
            if held and last:
                done.append((held[0], held[1], float(held[2] >= 0.5)))
                held = None
            rows = done + ([held] if held else [])
            source, bucket = table.column("source")[0].as_py(), table.column("bucket")[0].as_py()
            return pa.table([[source] * len(rows), [bucket] * len(rows), *map(list, zip(*rows))], schema=table.select(["source", "bucket", "id", "words", "fraction"]).schema)

        out = level.select("source", "bucket", "id", "words", "fraction").groupBy("source", "bucket").applyInArrow(rounded, f"source string, bucket long, id {kind}, words long, fraction double")
        out = materialize(out, "rounded")
        finished.append(out.where("fraction in (0, 1)").select("source", "id", "words", F.col("fraction").cast("int").alias("up")))
        level = out.where("fraction not in (0, 1)").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        most = 0 if last else -(-most // fan_in)
    result = finished[0]
    for x in finished[1:]:
        result = result.unionByName(x)
    return result


def plan_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **targets) -> DataFrame:
    """``(id, source, size, source_size, target, copies, rows)`` for each distinct (id, source, size) of ``docs``.

    Rows alike in all three are rounded as one. Null texts have size 0 and documents
    of size 0 take the copies that all of their source get for certain; a null
    source is a source, the last one; an empty table gives no rows.
    """
    units = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    units = materialize(units.groupBy("id", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    goals = source_targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), **targets)
    goals = materialize(goals, "targets").withColumnRenamed("source", "__s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.join(goals, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumns({"sure": F.floor(share + 1e-12), "fraction": F.greatest(share - F.floor(share + 1e-12), F.lit(0.0))})
    units = materialize(units, "units")
    key = F.concat(F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.lit("n")), F.lit(":"), F.col("size").cast("string"))
    open_units = units.where("fraction > 0 and size > 0").select("source", key.alias("id"), (F.col("size") * F.col("rows")).alias("words"), "fraction")
    drawn = round_fractions(open_units, seed).select(F.col("source").alias("__s"), F.col("id").alias("__i"), "up")
    same = F.col("source").eqNullSafe(F.col("__s")) & (key == F.col("__i"))
    copies = (F.col("sure") + F.coalesce("up", F.lit(0))).cast("int")
    return units.join(drawn, same, "left").select("id", "source", "size", "source_size", "target", copies.alias("copies"), "rows")


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes from each document: ``(doc_id, size, source_size, target, taken)``, a row for each row of ``docs``."""
    plan = plan_copies(docs)
    return plan.select(F.explode(F.array_repeat(F.struct(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")), F.col("rows").cast("int"))).alias("r")).select("r.*")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows of ``docs``, all columns, each repeated as often as drawn.

    Rows alike in id, source and size are drawn as one; null ids and sources are values
    like others; a text without words comes as often as all of its source do for certain; an empty table gives no rows.
    """
    plan = plan_copies(docs, id_col, text_col, source_col, **options).where("copies > 0").select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "copies")
    of = lambda c: F.col(f"row.`{c}`")
    same = of(id_col).eqNullSafe(F.col("__id")) & of(source_col).cast("string").eqNullSafe(F.col("__source")) & (word_count(of(text_col)) == F.col("__size"))
    drawn = as_row(docs).join(plan, same)
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
