"""Full-text article XML as tables: one parse for each document, child tables by explode.

XML with a document type or broken markup would fail a job in Spark's own XPath
functions, so each Arrow batch is parsed by the standard library; errors become a column.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTICLE = (
    "error string, title string, journal string, doi string, pmcid string, pmid string, abstract string, volume string, issue string, pages string, pub_date string, "
    "keywords array<string>, license string, authors array<struct<name:string,orcid:string,affiliations:array<string>>>, affiliations array<struct<id:string,text:string>>, "
    "funding array<struct<source:string,award:string>>, sections array<struct<title:string,content:string>>, "
    "tables array<struct<id:string,label:string,caption:string,headers:array<string>,rows:array<array<string>>>>, "
    "figures array<struct<id:string,label:string,caption:string,graphic:string>>, "
    "references array<struct<id:string,title:string,source:string,year:string,doi:string,pmid:string,raw:string>>, tags array<string>"
)
LINK = "{http://www.w3.org/1999/xlink}href"


def text_of(node: ET.Element | None) -> str | None:
    """All text below a node, parts joined by single spaces."""
    if node is None:
        return None
    return " ".join(" ".join(x.split()) for x in node.itertext() if x.strip())


def page_range(first: str | None, last: str | None) -> str | None:
    return f"{first}-{last}" if first and last else first or last


def pub_date(root: ET.Element) -> str | None:
    """Print, electronic, then collection date, in as many parts as it has."""
    dates = {d.get("pub-type") or d.get("date-type"): d for d in root.iter("pub-date")}
    chosen = next((dates[k] for k in ("ppub", "epub", "collection") if k in dates), next(iter(dates.values()), None))
    if chosen is None:
        return None
    parts = [(chosen.findtext(x) or "").strip() for x in ("year", "month", "day")]
    known = [p.zfill(2) for p in parts[: parts.index("") if "" in parts else 3]]
    return "-".join(known) or None


def child_tables(root: ET.Element) -> list[dict]:
    out = []
    for t in root.iter("table-wrap"):
        rows = [[text_of(c) or "" for c in r if c.tag in ("td", "th")] for r in t.iter("tr") if any(c.tag == "td" for c in r)]
        heads = [text_of(c) or "" for h in t.iter("thead") for c in h.iter("th")]
        out.append({"id": t.get("id"), "label": text_of(t.find("label")), "caption": text_of(t.find("caption")), "headers": heads, "rows": rows})
    return out


def references(root: ET.Element) -> list[dict]:
    out = []
    for r in root.iter("ref"):
        ids = {i.get("pub-id-type"): (i.text or "").strip() for i in r.iter("pub-id")}
        find = lambda name: text_of(next(r.iter(name), None))  # noqa: B023, E731
        out.append({"id": r.get("id"), "title": find("article-title"), "source": find("source"), "year": find("year"), "doi": ids.get("doi"), "pmid": ids.get("pmid"), "raw": text_of(r)})
    return out


def parse_article(xml: str | None) -> dict:
    """The fields of ``ARTICLE``; an unreadable document has just ``error``."""
    if not xml or not xml.strip():
        return {"error": "empty document"}
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", xml, count=1))
    except ET.ParseError as e:
        return {"error": str(e)}
    for node in root.iter():
        if isinstance(node.tag, str) and "}" in node.tag:
            node.tag = node.tag.rpartition("}")[2]
    one = lambda path: text_of(root.find(path))
    ids = {i.get("pub-id-type"): (i.text or "").strip() for i in root.findall(".//article-meta/article-id")}
    authors = []
    for c in root.findall(".//contrib-group/contrib"):
        name = c.find("name")
        if name is not None and c.get("contrib-type", "author") == "author":
            orcid = next((re.sub(r"^.*orcid\.org/", "", (i.text or "").strip()) for i in c.iter("contrib-id") if i.get("contrib-id-type") == "orcid"), None)
            full = " ".join(x for x in ((name.findtext("given-names") or "").strip(), (name.findtext("surname") or "").strip()) if x)
            authors.append({"name": full, "orcid": orcid, "affiliations": [x.get("rid") for x in c.iter("xref") if x.get("ref-type") == "aff"]})
    body = root.find(".//body")
    sections = [{"title": text_of(s.find("title")), "content": " ".join(text_of(p) or "" for p in s.iter("p"))} for s in (body.iter("sec") if body is not None else ())]
    figures = [{"id": f.get("id"), "label": text_of(f.find("label")), "caption": text_of(f.find("caption")), "graphic": next((g.get(LINK) for g in f.iter("graphic")), None)} for f in root.iter("fig")]
    awards = [{"source": text_of(next(iter(g.iter("institution")), g.find("funding-source"))), "award": text_of(g.find("award-id"))} for g in root.iter("award-group")]
    return {
        "title": one(".//title-group/article-title"), "journal": one(".//journal-title"), "doi": ids.get("doi"), "pmcid": ids.get("pmc") or ids.get("pmcid"), "pmid": ids.get("pmid"),
        "abstract": one(".//abstract"), "volume": one(".//article-meta/volume"), "issue": one(".//article-meta/issue"), "pages": page_range(one(".//article-meta/fpage"), one(".//article-meta/lpage")),
        "pub_date": pub_date(root), "keywords": [text_of(k) or "" for k in root.iter("kwd")], "license": one(".//license"), "authors": authors,
        "affiliations": [{"id": a.get("id"), "text": text_of(a)} for a in root.iter("aff")], "funding": awards, "sections": sections, "tables": child_tables(root), "figures": figures,
        "references": references(root), "tags": [n.tag for n in root.iter() if isinstance(n.tag, str)],
    }


#: Documents and characters that are parsed at once: their fields take many times the room of their text.
PART_ROWS, PART_CHARS = 200, 1_000_000


def parts(xml: pd.Series) -> Iterator[list[str | None]]:
    """A batch in pieces of bounded size; a longer document is a piece of its own."""
    held, chars = [], 0
    for x in xml:
        if held and (len(held) >= PART_ROWS or chars + len(x or "") > PART_CHARS):
            yield held
            held, chars = [], 0
        held.append(x)
        chars += len(x or "")
    if held:
        yield held


def parse(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """``docs``' ids with a column ``article`` of the fields above."""
    names = [x.split(" ")[0] for x in ARTICLE.replace("<", " <").split(", ")]

    @F.pandas_udf(f"struct<{_as_struct(ARTICLE)}>")
    def articles(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for xml in batches:
            for part in parts(xml):
                rows = [parse_article(x) for x in part]
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names, dtype=object)

    return docs.select(F.col(id_col).alias("paper_id"), articles(F.col(xml_col)).alias("article"))


def _as_struct(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in ddl.split(", ")))


def child(articles: DataFrame, name: str) -> DataFrame:
    """A child table (sections, tables, figures, references, authors, funding) by paper and position."""
    return articles.select("paper_id", F.posexplode(f"article.{name}").alias("pos", "x")).select("paper_id", "pos", "x.*")


def tag_frequencies(articles: DataFrame) -> DataFrame:
    return articles.select(F.explode("article.tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def schema_coverage(articles: DataFrame, known: list[str]) -> DataFrame:
    """How many distinct tags are known, and their share in percent."""
    tags = tag_frequencies(articles).select((F.col("tag").isin(known)).alias("known"))
    return tags.agg(F.count("*").alias("tags"), F.count_if("known").alias("known_tags"), F.round(F.avg(F.col("known").cast("double")) * 100, 2).alias("coverage_percent"))


def schema_flags(articles: DataFrame) -> DataFrame:
    has = lambda tag: F.array_contains("article.tags", tag)
    return articles.select("paper_id", has("table-wrap").alias("has_tables"), has("fig").alias("has_figures"), has("supplementary-material").alias("has_supplementary"), has("ack").alias("has_acknowledgments"), (has("funding-group") | has("award-group")).alias("has_funding"))


def plain_text(articles: DataFrame) -> DataFrame:
    a = F.col("article")
    body = F.array_join(F.transform(a["sections"], lambda s: F.concat_ws("\n", s["title"], s["content"])), "\n\n")
    return articles.select("paper_id", F.concat_ws("\n\n", a["title"], F.array_join(F.transform(a["authors"], lambda x: x["name"]), ", "), a["abstract"], F.nullif(body, F.lit(""))).alias("text"))


def markdown(articles: DataFrame) -> DataFrame:
    a = F.col("article")
    body = F.array_join(F.transform(a["sections"], lambda s: F.concat(F.lit("## "), F.coalesce(s["title"], F.lit("")), F.lit("\n\n"), s["content"])), "\n\n")
    return articles.select("paper_id", F.concat_ws("\n\n", F.concat(F.lit("# "), a["title"]), F.concat(F.lit("**Authors:** "), F.nullif(F.array_join(F.transform(a["authors"], lambda x: x["name"]), ", "), F.lit(""))), F.concat(F.lit("## Abstract\n\n"), a["abstract"]), F.nullif(body, F.lit(""))).alias("markdown"))
