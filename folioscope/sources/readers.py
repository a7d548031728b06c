"""Readers of landed payloads and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER_RAW = (
    "id string, source string, pmid string, pmcid string, doi string, title string, authorString string, journalTitle string, issue string, journalVolume string, "
    "pubYear string, journalIssn string, pageInfo string, pubType string, isOpenAccess string, inEPMC string, inPMC string, hasPDF string, hasReferences string, "
    "hasTextMinedTerms string, hasDbCrossReferences string, citedByCount string, firstPublicationDate string, abstractText string, affiliation string, language string, license string, "
    "journalInfo struct<journal:struct<title:string>>, bookOrReportDetails struct<publisher:string>, "
    "meshHeadingList struct<meshHeading:array<struct<descriptorName:string,majorTopic_YN:string>>>, grantsList struct<grant:array<struct<agency:string,grantId:string>>>, "
    "keywordList struct<keyword:array<string>>, authorList struct<author:array<struct<fullName:string,firstName:string,lastName:string,initials:string>>>, "
    "fullTextUrlList struct<fullTextUrl:array<struct<availabilityCode:string,url:string>>>"
)
ENVELOPE = f"version string, hitCount bigint, nextCursorMark string, resultList struct<result:array<struct<{PAPER_RAW.replace(' string', ':string').replace(' struct<', ':struct<')}>>>"
DC_FIELDS = ("title", "creator", "subject", "description", "publisher", "date", "type", "identifier", "source", "language", "rights")


def search_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of search response files; an empty or missing list gives none, unreadable files one corrupt row that is dropped."""
    pages = spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return pages.select(F.inline("resultList.result"))


def search_xml(spark: SparkSession, path: str, schema: str = PAPER_RAW) -> DataFrame:
    """Records of the XML form: one flat row for each ``result``."""
    flat = ", ".join(x for x in schema.split(", ") if x.endswith(" string"))
    return spark.read.format("xml").option("rowTag", "result").schema(flat).load(path)


def dublin_core(spark: SparkSession, path: str) -> DataFrame:
    """``rdf:Description`` rows; every field is an array, and a missing title an empty one."""
    schema = ", ".join(f"`dc:{f}` array<string>" for f in DC_FIELDS)
    rows = spark.read.format("xml").option("rowTag", "rdf:Description").schema(schema).load(path)
    named = rows.select(*(F.col(f"`dc:{f}`").alias(f) for f in DC_FIELDS))
    return named.withColumn("title", F.coalesce("title", F.array(F.lit(""))))


def search_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def ids_only(records: DataFrame) -> DataFrame:
    return records.select("id").where("id <> ''")


def metadata_files(spark: SparkSession, path: str, schema: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json")
    return (reader.option("recursiveFileLookup", True) if recursive else reader).json(path)


def select_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns that exist."""
    return df.select([c for c in names if c in df.columns])


def rename_fields(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """``value``: each row as a line of a Markdown table; ``markdown_header`` goes before them."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_header(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)


def ris_lines(papers: DataFrame) -> DataFrame:
    """``value``: a reference-manager entry for each paper."""
    tag = lambda t, c: F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.concat(F.lit(f"{t}  - "), F.col(c).cast("string"), F.lit("\n")))
    parts = [F.coalesce(tag(t, c), F.lit("")) for t, c in (("TI", "title"), ("JO", "journalTitle"), ("PY", "pubYear"), ("DO", "doi"), ("AB", "abstractText")) if c in papers.columns]
    return papers.select(F.concat(F.lit("TY  - JOUR\n"), *parts, F.lit("ER  - \n")).alias("value"))
