"""Graphs in storage: a table that grows by increments, and files in Turtle.

The table is partitioned by a hash of the subject; an increment opens only the partitions of its own
subjects, and adds files there. Rows meet what is stored before they become facts. Turtle files are clustered
by subject: rows are range-partitioned and sorted, and each task writes its rows in one pass, whatever number
of rows a subject has.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.graph import COLUMNS, PREFIXES
from folioscope.sources.tables import cut

#: Partitions of a stored graph, and parts of each of them that tasks work on.
BUCKETS, PARTS = 64, 8
#: Types whose subjects are content of papers; all other subjects are metadata.
CONTENT = ("bibo:DocumentPart", "bibo:Table", "bibo:Row", "bibo:Image", "bibo:Article")
SCHEMA = "s string, p string, o string, o_kind string, o_datatype string, g string"
#: What facts of a kind have in common, and a fact without its subject.
KIND = ("p", "o_kind", "o_datatype", "g")
FACT = "struct<k:int,o:string,kind:struct<p:string,o_kind:string,o_datatype:string,g:string>>"
Kinds = Sequence[tuple[str, str, str | None, str]]
Facts = Callable[[Column], Column]


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("s"), F.lit(buckets)).cast("int").alias("bucket")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, bucket int").parquet(path)


def held_as(kinds: Kinds) -> tuple[Column, Column]:
    """Number of a row's kind among ``kinds``, and its kind where it has no number there, so that rows carry one of the two."""
    same = (reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(KIND, kind))) for kind in kinds)
    k = F.coalesce(*(F.when(x, i) for i, x in enumerate(same)), F.lit(None).cast("int"))
    return k, F.when(k.isNull(), F.struct(*KIND))


def as_rows(graph: DataFrame) -> DataFrame:
    """A graph as rows of a subject and what ``as_they_are`` makes its fact of."""
    return graph.select("s", F.struct("o", F.struct(*KIND).alias("kind")).alias("row"))


def as_they_are(row: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast("int").alias("k"), row["o"].alias("o"), row["kind"].alias("kind")))


def fresh(rows: DataFrame, kinds: Kinds, facts: Facts, buckets: int) -> DataFrame:
    """What ``facts`` makes of each ``row`` and no row with the same subject has in ``held``, each once, with its ``bucket``.

    Rows and held facts meet by one exchange and become facts afterwards. A subject's rows are in one part of its
    partition, as any of them may give any of its facts; the rows of a graph are dealt to parts by their objects.
    """
    dealt = F.col("s") if kinds else F.coalesce("held.o", "row.o")
    part = F.pmod(F.shiftright(F.xxhash64(dealt), 32), F.lit(PARTS)).cast("int")
    met = rows.withColumns({"bucket": bucket(buckets), "part": part}).repartition("bucket", "part")
    kept = F.col("held").isNotNull()
    found = met.select("bucket", "part", "s", kept.alias("kept"), F.explode(F.when(kept, F.array("held")).otherwise(facts(F.col("row")))).alias("x")).where("x is not null")
    once = found.groupBy("bucket", "part", "s", F.col("x.k").alias("k"), F.col("x.o").alias("o"), F.col("x.kind").alias("kind")).agg(F.max("kept").alias("kept")).where("not kept")
    named = (F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col("k")) for values in zip(*kinds)) if kinds else [F.lit(None)] * len(KIND)
    whole = {c: F.when(F.col("k").isNull(), F.col("kind")[c]).otherwise(v) for c, v in zip(KIND, named)}
    return once.withColumns(whole).select(*COLUMNS, "bucket")


def store(graph: DataFrame, path: str, buckets: int = BUCKETS, kinds: Kinds = (), facts: Facts = as_they_are) -> None:
    """Write a graph as a table, each of its rows once.

    ``graph`` has the graph's rows or, with ``facts``, rows ``(s, row)``: ``facts`` makes an array of structs
    (k: place in ``kinds``, o, kind: null) of a row; null is no fact. ``kinds`` are (p, o_kind, o_datatype, g).
    """
    rows = graph if kinds else as_rows(graph)
    fresh(rows.withColumn("held", F.lit(None).cast(FACT)), kinds, facts, buckets).write.partitionBy("bucket").parquet(path)


def add(graph: DataFrame, path: str, buckets: int = BUCKETS, kinds: Kinds = (), facts: Facts = as_they_are) -> list[int]:
    """Add the rows of ``graph`` that the table at ``path`` lacks; the partitions that got some.

    Only partitions of the increment's subjects are read; files that were there stay as they are. Running it
    again adds nothing. ``graph``, ``kinds`` and ``facts`` are as in ``store``. A graph is written down first, so it
    is worked out once; rows for ``facts`` are read twice, so they should come from files.
    """
    spark = graph.sparkSession
    rows = graph if kinds else cut(as_rows(graph), "increment")
    touched = sorted(r.bucket for r in rows.select(bucket(buckets)).distinct().collect())  # at most the number of partitions
    if not touched:
        return []
    table = stored(spark, path)
    known = set(table.inputFiles())
    k, kind = held_as(kinds)
    held = table.where(F.col("bucket").isin(touched)).select("s", F.struct(k.alias("k"), "o", kind.alias("kind")).alias("held"))
    if kinds:  # what is of another kind equals no new fact
        held = held.where("held.k is not null")
    both = rows.select("s", "row", F.lit(None).cast(FACT).alias("held")).unionByName(held.select("s", F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "held"))
    fresh(both, kinds, facts, buckets).write.mode("append").partitionBy("bucket").parquet(path)
    return sorted({int(re.search(r"/bucket=(\d+)/[^/]*$", f)[1]) for f in stored(spark, path).inputFiles() if f not in known})


def by_kind(graph: DataFrame, kind: str) -> DataFrame:
    """The rows of content or metadata subjects, or all of them.

    Subjects of a content type (and their rows) are content; all others, papers, authors and institutions too, are metadata.
    """
    if kind == "complete":
        return graph
    types = [PREFIXES[t.split(":")[0]] + t.split(":")[1] for t in CONTENT]
    inside = graph.where((F.col("p") == PREFIXES["rdf"] + "type") & F.col("o").isin(types)).select("s").distinct()
    return graph.join(inside, "s", "left_semi" if kind == "content" else "left_anti")


NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
UNESCAPES = {v[1]: k for k, v in ESCAPES.items()}


class Writer:
    """Turtle lines of sorted rows; a prefix is declared where it is first used."""

    def __init__(self) -> None:
        self.known: set[str] = set()
        self.subject: tuple[str, str] | None = None

    def name(self, address: str, out: list[str]) -> str:
        for prefix, base in PREFIXES.items():
            if address.startswith(base) and NAME.fullmatch(address[len(base) :]):
                if prefix not in self.known:
                    self.known.add(prefix)
                    out.append(f"@prefix {prefix}: <{base}> .")
                return f"{prefix}:{address[len(base) :]}"
        return "<" + re.sub(r"[\x00-\x20<>\"{}|^`\\]", lambda m: f"\\u{ord(m[0]):04X}", address) + ">"

    def row(self, s: str, p: str, o: str, kind: str, datatype: str | None, g: str) -> list[str]:
        """Lines of one row: declarations, a comment for a new graph, the subject if it is new, and predicate and object."""
        out: list[str] = []
        predicate = self.name(p, out)
        if kind == "iri":
            target = self.name(o, out)
        else:
            target = '"' + re.sub(r'[\\"\n\r\t]', lambda m: ESCAPES[m[0]], o) + '"'
            target += "^^" + self.name(datatype, out) if datatype else ""
        subject = self.name(s, out)
        fresh = self.subject != (g, s)
        if out or fresh:  # declarations stand between sentences
            if self.subject is not None:
                out.insert(0, "  .")
            if self.subject is None or self.subject[0] != g:
                out.append(f"# graph {g}")
            out.append(subject)
            self.subject = (g, s)
            return [*out, f"  {predicate} {target}"]
        return [f"  ; {predicate} {target}"]

    def end(self) -> list[str]:
        return ["  ."] if self.subject is not None else []


def write_turtle(graph: DataFrame, path: str, partitions: int | None = None) -> None:
    """Compressed Turtle files, each the rows of a range of graphs and subjects; an empty graph gives files without sentences."""
    order = ["g", "s", "p", "o", "o_datatype"]
    rows = graph.select(*COLUMNS)
    rows = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(writer.row(*r)) for r in zip(*(c.to_pylist() for c in b.columns))], pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(writer.end(), pa.string())], ["value"])

    rows.mapInArrow(lines, "value string").write.option("compression", "gzip").text(path)


TOKEN = re.compile(r'<([^>]*)>|"((?:[^"\\]|\\.)*)"|(\^\^)|([A-Za-z][\w-]*):([\w-]+)')


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The rows of files of ``write_turtle``; a compressed file is read in one piece, so that its lines keep their order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes: dict[str, str] = {}
        graph = subject = None

        def address(m: re.Match) -> str:
            return re.sub(r"\\u([0-9A-F]{4})", lambda x: chr(int(x[1], 16)), m[1]) if m[1] is not None else prefixes[m[4]] + m[5]

        for b in batches:
            found = []
            for line in b.column(0).to_pylist():
                if line.startswith("@prefix "):
                    name, _, base = line[8:-2].partition(": ")
                    prefixes[name] = base[1:-1]
                elif line.startswith("# graph "):
                    graph = line[8:]
                elif line.startswith("  ") and line != "  .":
                    p, o, *rest = TOKEN.finditer(line)
                    literal = o[2] is not None
                    value = re.sub(r"\\(.)", lambda x: UNESCAPES[x[1]], o[2]) if literal else address(o)
                    found.append((subject, address(p), value, "literal" if literal else "iri", address(rest[1]) if rest else None, graph))
                elif line and not line.startswith("  "):
                    subject = address(TOKEN.match(line))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)] if found else [pa.array([], pa.string())] * 6, list(COLUMNS))

    return spark.read.text(path).mapInArrow(rows, SCHEMA)
