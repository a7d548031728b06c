"""Text-mining annotations: entities, sentences and relationships from nested rows.

Input rows have ``exact, prefix, postfix, section, type, provider, article, tags``
(array of ``uri, name, type``), ``relation`` and ``target``; see ``SCHEMA``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "pos long, article string, type string, exact string, prefix string, postfix string, section string, provider string, target string, relation string, tags array<struct<uri:string,name:string,type:string>>"


def entity_type(uri: Column, stated: Column) -> Column:
    """The stated type, else the collection in an identifiers.org address, else the CURIE's prefix."""
    path = F.nullif(F.regexp_extract(uri, "identifiers\\.org/([^/:]+)", 1), F.lit(""))
    curie = F.nullif(F.regexp_extract(uri, "^([A-Za-z][\\w.]*):(?!//)", 1), F.lit(""))
    return F.coalesce(F.nullif(stated, F.lit("")), path, curie, F.lit("Unknown"))


def entities(annotations: DataFrame) -> DataFrame:
    """One row for each tag, or for the annotation where it has none; the first of equal ones stays.

    An entity without an address gets an id from its digest, the same in every run.
    """
    flat = annotations.select("*", F.posexplode_outer("tags").alias("tag_pos", "tag"))
    named = flat.select(
        "pos", F.coalesce("tag_pos", F.lit(0)).alias("tag_pos"), "article", "exact", "section", "provider",
        F.coalesce(F.nullif(F.col("tag.uri"), F.lit("")), F.concat(F.lit("entity:"), F.substring(F.sha2(F.concat_ws("|", "article", "exact", "type").cast("binary"), 256), 1, 16))).alias("entity_id"),
        F.coalesce("tag.name", "exact").alias("entity_name"), entity_type(F.col("tag.uri"), F.coalesce("tag.type", "type")).alias("entity_type"),
    )
    keys = ["article", "entity_id", "entity_name", "entity_type", "exact", "section"]
    return named.groupBy(*keys).agg(F.min_by("provider", F.struct("pos", "tag_pos")).alias("provider"), F.min("pos").alias("pos"))


def sentences(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.contains(F.lower("type"), F.lit("sentence")) & F.col("target").isNotNull()).select("pos", "article", F.col("exact").alias("sentence"), "section", "provider")


def relationships(annotations: DataFrame) -> DataFrame:
    """Annotations with two tags or more that state a relation: first tag, predicate, second tag."""
    is_relation = F.col("relation").isNotNull() | F.contains(F.lower("type"), F.lit("relationship"))
    kept = annotations.where((F.size("tags") >= 2) & F.coalesce(is_relation, F.lit(False)))
    return kept.select("pos", "article", F.col("tags")[0]["name"].alias("subject"), F.coalesce("relation", F.lit("related_to")).alias("predicate"), F.col("tags")[1]["name"].alias("object"))


#: The parts of landed answers that are read. A provider, annotator or creator is text or an object with a name;
#: a target is text or an object, so these stay JSON text until they are looked at.
LANDED = (
    "totalCount bigint, page int, pageSize int, version string, source string, annotations array<struct<pmcid:string,source:string,extId:string,type:string,exact:string,prefix:string,postfix:string,"
    "section:string,provider:string,annotator:string,creator:string,target:string,body:string,relation:string,tags:array<struct<uri:string,name:string,type:string>>,annotations:string>>"
)
NESTED = "array<struct<pmcid:string,source:string,extId:string,type:string,exact:string,prefix:string,postfix:string,section:string,provider:string,annotator:string,creator:string,target:string,body:string,relation:string,tags:array<struct<uri:string,name:string,type:string>>>>"
#: Where addresses of articles begin, unless a caller names another place.
ARTICLES = "https://example.org/articles/"


def name_or_text(c: Column) -> Column:
    """The name of an object, or plain text."""
    return F.when(F.startswith(c, F.lit("{")), F.get_json_object(c, "$.name")).otherwise(F.nullif(c, F.lit("")))


def provider_of(a: Column) -> Column:
    return F.coalesce(*(name_or_text(a[x]) for x in ("provider", "annotator", "creator")), F.lit("Unknown"))


def in_target(a: Column, field: str) -> Column:
    return F.when(F.startswith(a["target"], F.lit("{")), F.nullif(F.get_json_object(a["target"], f"$.{field}"), F.lit("")))


def pmc(c: Column) -> Column:
    return F.concat(F.lit("PMC"), F.replace(F.nullif(c, F.lit("")), F.lit("PMC"), F.lit("")))


def article_id(a: Column) -> Column:
    """The target's article first, then the annotation's own."""
    own = F.concat_ws("/", F.nullif(a["source"], F.lit("")), F.nullif(a["extId"], F.lit("")))
    return F.coalesce(pmc(in_target(a, "pmcid")), in_target(a, "source"), pmc(a["pmcid"]), F.when(a["extId"] != "", own))


def article_uri(a: Column, base: str = ARTICLES) -> Column:
    """The annotation's own article first, then the target's."""
    both = lambda x, y: F.when((x != "") & (y != ""), F.concat(x, F.lit("/"), y))
    target = both(in_target(a, "source"), F.coalesce(in_target(a, "extId"), in_target(a, "id")))
    named = F.when(in_target(a, "source").isNotNull(), pmc(in_target(a, "pmcid")))
    return F.concat(F.lit(base), F.coalesce(pmc(a["pmcid"]), both(a["source"], a["extId"]), target, named))


def body_type(a: Column) -> Column:
    """The kind of concept that a body's address stands for, else the annotation's type."""
    found = F.upper(F.get(F.split(a["body"], "/"), F.lit(3)))
    return F.coalesce(F.when(F.contains(a["body"], F.lit("browser.ihtsdotools.org")), "SNOMED_CT").when(F.contains(a["body"], F.lit("identifiers.org")), found), F.nullif(a["type"], F.lit("")), F.lit("Unknown"))


def section_of(a: Column) -> Column:
    return F.coalesce(in_target(a, "isPartOf"), in_target(a, "section"), a["section"], F.lit(""))


def landed(responses: DataFrame, key: str = "id", json: str = "json", base: str = ARTICLES) -> DataFrame:
    """Landed answers as annotation rows: ``key``, ``pos`` in the answer and the columns of ``SCHEMA`` with article addresses.

    An annotation may stand in an object of its article, whose ids it takes where it
    has none; ``pos`` counts by article object first. Answers that are no JSON give no rows.
    """
    def nested(a: Column) -> Column:
        own = lambda child, name: F.coalesce(child[name], a[name]).alias(name)
        rest = ("type", "exact", "prefix", "postfix", "section", "provider", "annotator", "creator", "target", "body", "relation", "tags")
        flat = F.struct(*(a[x].alias(x) for x in ("pmcid", "source", "extId", *rest)))
        children = F.from_json(a["annotations"], NESTED)
        return F.when(a["annotations"].isNotNull(), F.transform(children, lambda c: F.struct(own(c, "pmcid"), own(c, "source"), own(c, "extId"), *(c[x].alias(x) for x in rest)))).otherwise(F.array(flat))

    answers = responses.select(key, F.from_json(F.col(json), LANDED).alias("r"))
    rows = answers.select(key, F.posexplode(F.flatten(F.transform("r.annotations", nested))).alias("pos", "a"))
    a = F.col("a")
    return rows.select(
        key, F.col("pos").cast("long").alias("pos"), article_id(a).alias("article"), article_uri(a, base).alias("article_uri"), "a.type", "a.exact", "a.prefix", "a.postfix", section_of(a).alias("section"),
        provider_of(a).alias("provider"), "a.target", "a.body", body_type(a).alias("body_type"), "a.relation", F.coalesce("a.tags", F.array().cast("array<struct<uri:string,name:string,type:string>>")).alias("tags"),
    )


def response_facts(responses: DataFrame, key: str = "id", json: str = "json") -> DataFrame:
    """Totals and paging of landed answers; ``valid`` is false where the text is no object."""
    r = responses.select(key, F.from_json(F.col(json), "totalCount bigint, page int, pageSize int, version string, source string").alias("r"), F.startswith(F.trim(F.col(json)), F.lit("{")).alias("valid"))
    return r.select(key, F.coalesce("r.totalCount", F.lit(0).cast("long")).alias("total_count"), F.coalesce("r.page", F.lit(1)).alias("page"), F.coalesce("r.pageSize", F.lit(25)).alias("page_size"), F.coalesce("r.version", F.lit("")).alias("version"), F.coalesce("r.source", F.lit("")).alias("source"), F.coalesce("valid", F.lit(False)).alias("valid"))


def annotation_errors(annotations: DataFrame) -> DataFrame:
    """``annotations`` with ``errors``: what a row lacks to be an annotation, an entity or a relationship."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    linked = F.col("relation").isNotNull()
    faults = {
        "exact text is missing": blank("exact"), "article is missing": blank("article"), "entity has neither address nor name": ~linked & F.exists("tags", lambda t: t["uri"].isNull() & t["name"].isNull()),
        "relationship needs two entities": linked & (F.size("tags") < 2), "relation is blank": linked & blank("relation"),
    }
    return annotations.withColumn("errors", F.array_compact(F.array(*(F.when(test, F.lit(text)) for text, test in faults.items()))))
