"""Knowledge-graph rows: entities as (s, p, o, kind, datatype, graph) with set semantics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.identifiers import slug

#: Namespaces of the terms used here.
PREFIXES = {
    "bibo": "http://purl.org/ontology/bibo/",
    "cito": "http://purl.org/spar/cito/",
    "dcterms": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "owl": "http://www.w3.org/2002/07/owl#",
    "prov": "http://www.w3.org/ns/prov#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}
BASE = "https://example.org/kg/"
COLUMNS = ("s", "p", "o", "o_kind", "o_datatype", "g")


def iri(name: str) -> str:
    prefix, _, local = name.partition(":")
    return PREFIXES[prefix] + local if prefix in PREFIXES else name


#: What the facts of a kind have in common, (p, o_kind, o_datatype, g), by the number that stands for it in ``fact``.
KINDS: dict[tuple[str, str, str | None, str], int] = {}
FACTS = "array<struct<s:string,k:int,o:string>>"


def fact(s: Column, p: str, o: Column, g: str, datatype: str | None = None) -> Column:
    """One row of the graph as a struct of subject, number of its kind and object, so that exchanges carry no more; without a datatype the object is an address."""
    kind = (iri(p), "iri" if datatype is None else "literal", None if datatype is None else iri(datatype), g)
    return F.struct(s.alias("s"), F.lit(KINDS.setdefault(kind, len(KINDS))).alias("k"), o.cast("string").alias("o"))


def field_facts(subject: Column, fields: dict[str, tuple[str, str]], g: str) -> list[Column]:
    """Facts of columns: field -> (predicate, datatype or "iri")."""
    return [fact(subject, p, F.col(c), g, None if t == "iri" else t) for c, (p, t) in fields.items()]


def link_facts(subject: Column, predicate: str, target: Column, g: str, inverse: str | None = None) -> list[Column]:
    """An address for each row, and the way back if it is named."""
    there = [fact(subject, predicate, target, g)]
    return there + [fact(target, inverse, subject, g)] if inverse else there


def given(items: Column) -> Column:
    """The facts of an array that have a subject and an object."""
    return F.filter(items, lambda x: x["s"].isNotNull() & (x["o"] != ""))


def coded(df: DataFrame, facts: list[Column], lists: list[Column] | None = None) -> DataFrame:
    """``(s, k, o)`` of all facts of each row, single ones and arrays of them, by one explode; they may repeat.

    Facts whose subject or object is null or empty are left out.
    """
    items = F.array(*facts) if facts else None
    for more in lists or []:
        some = F.coalesce(more, F.array().cast(FACTS))
        items = some if items is None else F.concat(items, some)
    return df.select(F.explode(given(items)).alias("x")).select("x.s", "x.k", "x.o")


def decoded(rows: DataFrame) -> DataFrame:
    """The graph's rows of ``(s, k, o)``."""
    p, o_kind, o_datatype, g = (F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.col("k")) for values in zip(*KINDS))
    return rows.select("s", p.alias("p"), "o", o_kind.alias("o_kind"), o_datatype.alias("o_datatype"), g.alias("g"))


def emitted(df: DataFrame, facts: list[Column], lists: list[Column] | None = None) -> DataFrame:
    """All facts of each row, each once: one scan and one exchange."""
    return decoded(coded(df, facts, lists).distinct())


def emitted_by(df: DataFrame, key: Column, fields: list[str], made: Callable[[Column, Column], Column], combine: bool = True) -> DataFrame:
    """The facts that ``made(key, row)`` gives, as an array, for the fields of each row, each once.

    The rows meet by key before they become facts, so the exchange carries rows; no fact may come from two keys.
    ``combine`` makes rows distinct before the exchange too, which is of use where keys repeat a lot.
    """
    rows = df.select(key.alias("__key"), F.struct(*fields).alias("x")).where("__key is not null")
    held = (rows if combine else rows.repartition("__key")).groupBy("__key").agg(F.collect_set("x").alias("held"))
    facts = F.array_distinct(F.flatten(F.transform("held", lambda x: made(F.col("__key"), x))))
    return decoded(held.select(F.explode(given(facts)).alias("x")).select("x.s", "x.k", "x.o"))


def triples(df: DataFrame, subject: Column, fields: dict[str, tuple[str, str]], graph: str) -> DataFrame:
    """Melt columns: field -> (predicate, datatype or "iri"); null and empty values make no row, and each row comes once."""
    return emitted(df, field_facts(subject, fields, graph))


def links(df: DataFrame, subject: Column, predicate: str, target: Column, graph: str, inverse: str | None = None) -> DataFrame:
    """One IRI triple for each row, and its inverse if one is named; duplicates go."""
    return emitted(df, link_facts(subject, predicate, target, graph, inverse))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def paper_uri() -> Column:
    """By DOI, else by id."""
    return F.coalesce(F.concat(F.lit(BASE + "doi/"), F.nullif(F.col("doi"), F.lit(""))), F.concat(F.lit(BASE + "paper/"), F.col("id").cast("string")))


def author_uri(name: Column) -> Column:
    return F.concat(F.lit(BASE + "author/"), slug(name))


def institution_uri(name: Column) -> Column:
    """By a digest of the name, which is the same in every run."""
    return F.concat(F.lit(BASE + "org/"), F.substring(F.sha2(name.cast("binary"), 256), 1, 16))


PAPER_FIELDS = {
    "title": ("dcterms:title", "xsd:string"),
    "doi": ("bibo:doi", "xsd:string"),
    "pubYear": ("dcterms:issued", "xsd:gYear"),
    "journalTitle": ("dcterms:isPartOf", "xsd:string"),
    "citedByCount": ("bibo:citedBy", "xsd:integer"),
    "abstractText": ("dcterms:abstract", "xsd:string"),
    "license": ("dcterms:license", "xsd:string"),
}


#: What the facts of a paper's fields have in common, by the places of the fields.
PAPER_KINDS = tuple((iri(p), "literal", iri(t), "publications") for p, t in PAPER_FIELDS.values())


def paper_facts(paper: Column) -> Column:
    """Facts of a paper, a struct of ``PAPER_FIELDS``, for ``sources.graph_store``; null where a field is null or empty."""
    kind = F.lit(None).cast("struct<p:string,o_kind:string,o_datatype:string,g:string>")
    values = (paper[c].cast("string") for c in PAPER_FIELDS)
    return F.array(*(F.when(o != "", F.struct(F.lit(i).alias("k"), o.alias("o"), kind.alias("kind"))) for i, o in enumerate(values)))


def paper_triples(papers: DataFrame) -> DataFrame:
    return triples(papers, paper_uri(), {c: t for c, t in PAPER_FIELDS.items() if c in papers.columns}, "publications")


def collaboration_links(authorship: DataFrame) -> DataFrame:
    """Author to author over a shared paper, both directions, no self links; each pair is made distinct once."""
    from folioscope.operators.network import shared_papers

    pairs = shared_papers(authorship).select("a", "b").distinct()
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    node = lambda c: F.concat(F.lit(BASE + "author/"), F.col(c).cast("string"))
    return decoded(coded(both.select("x.*"), link_facts(node("a"), "foaf:knows", node("b"), "collaborations")))


def citation_links(citations: DataFrame) -> DataFrame:
    node = lambda c: F.concat(F.lit(BASE + "paper/"), F.col(c).cast("string"))
    return links(citations, node("src"), "cito:cites", node("dst"), "citations", inverse="cito:isCitedBy")


def institution_members(affiliations: DataFrame) -> DataFrame:
    """``(org, name, members)`` from rows of (author, affiliation)."""
    known = affiliations.where("affiliation <> ''")
    return known.groupBy("affiliation").agg(F.count_distinct("author").alias("members")).select(institution_uri(F.col("affiliation")).alias("org"), F.col("affiliation").alias("name"), "members")


#: Points of a score beside its start of a half, and the least scores of the levels.
START = 0.5
PAPER_POINTS = {"doi": 0.2, "pmid": 0.1, "title": 0.1, "citedByCount": 0.1}
AUTHOR_POINTS = {"orcid": 0.2, "affiliation": 0.1, "name": 0.2}
INSTITUTION_POINTS = {"country": 0.1, "type": 0.1, "name": 0.1, "members": 0.1}
LEVELS = (("high", 0.8), ("medium", 0.6))


def score(points: dict[str, float], **tests: Column) -> Column:
    """A half and the points of each field that is given, or passes its own test; one at most."""
    total = F.lit(START)
    for field, value in points.items():
        passed = tests.get(field, F.col(field).cast("string") != "")
        total = total + F.when(passed, value).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def paper_quality() -> Column:
    return score(PAPER_POINTS, citedByCount=F.col("citedByCount") > 0)


def author_quality() -> Column:
    return score(AUTHOR_POINTS)


def institution_quality() -> Column:
    return score(INSTITUTION_POINTS, name=F.length("name") > 10, members=F.col("members") > 0)


def confidence_level(score: Column) -> Column:
    """The first level that a score reaches, else low; a hair of slack stands for sums of tenths."""
    level = F.lit("low")
    for name, least in reversed(LEVELS):
        level = F.when(score >= least - 1e-9, name).otherwise(level)
    return level


def provenance(df: DataFrame, subject: Column, sources: Column, run_ts: str, graph: str = "provenance") -> DataFrame:
    """When and from what each subject came; the time is a parameter, so reruns agree."""
    made = df.select(subject.alias("__s"), F.lit(run_ts).alias("__at"), sources.alias("__from")).distinct()
    return triples(made, F.col("__s"), {"__at": ("prov:generatedAtTime", "xsd:dateTime"), "__from": ("prov:hadPrimarySource", "xsd:string")}, graph)


def too_many_values(graph: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``(s, p, n)`` where a subject has more values of a predicate than a shape allows."""
    most = F.create_map(*(F.lit(x) for p, n in limits.items() for x in (iri(p), n)))
    watched = graph.where(F.col("p").isin(*(iri(p) for p in limits)))
    return watched.groupBy("s", "p").agg(F.count("*").alias("n")).where(F.col("n") > F.element_at(most, F.col("p")))


def n_quads(graph: DataFrame) -> DataFrame:
    """``value``: one line of N-Quads for each row, ready for a text sink."""
    escaped = F.replace(F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    literal = F.concat(F.lit('"'), escaped, F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), "o_datatype", F.lit(">")), F.lit("")))
    target = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(literal)
    return graph.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), target, F.lit(" <" + BASE + "graph/"), "g", F.lit("> .")).alias("value"))
