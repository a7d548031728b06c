"""A fielded Boolean query language: builder, parser, and compiler to a Column.

``(PUB_YEAR:[1996 TO 2000]) AND OPEN_ACCESS:y NOT "gene therapy"`` reads as a tree of
And, Or, Not and terms; ``compiled`` turns the tree into one predicate, which Catalyst
pushes to the scan like any other.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    """A value of a field (None: the default text fields); ``low`` and ``high`` for ranges, None for open ends."""

    name: str | None
    value: str = ""
    low: str | None = None
    high: str | None = None
    is_range: bool = False


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Field:
    """How a query field reads the paper table. kind: text, exact, flag or number."""

    column: str
    kind: str
    about: str


#: Query fields by name.
FIELDS = {
    "TITLE": Field("title", "text", "words of the title"),
    "ABSTRACT": Field("abstractText", "text", "words of the abstract"),
    "AUTH": Field("authorString", "text", "author names"),
    "AFF": Field("affiliation", "text", "affiliations"),
    "JOURNAL": Field("journalTitle", "text", "journal title"),
    "GRANT_AGENCY": Field("grants", "text", "funders"),
    "PUB_TYPE": Field("pubType", "text", "publication type"),
    "LICENSE": Field("license", "text", "licence"),
    "PUB_YEAR": Field("pubYear", "number", "publication year"),
    "CITED": Field("citedByCount", "number", "citation count"),
    "DOI": Field("doi", "exact", "digital object identifier"),
    "EXT_ID": Field("id", "exact", "identifier in the source"),
    "PMCID": Field("pmcid", "exact", "full-text identifier"),
    "SRC": Field("source", "exact", "source"),
    "OPEN_ACCESS": Field("isOpenAccess", "flag", "open access"),
    "HAS_PDF": Field("hasPDF", "flag", "has a PDF"),
    "IN_PMC": Field("inPMC", "flag", "full text in the first archive"),
    "IN_EPMC": Field("inEPMC", "flag", "full text in the second archive"),
    "HAS_ABSTRACT": Field("hasAbstract", "flag", "has an abstract"),
}
DEFAULT_TEXT = ("title", "abstractText")
_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)(?![\w:])|([A-Za-z_]+):\[\s*("[^"]*"|\S+)\s+TO\s+("[^"]*"|[^\]\s]+)\s*\]|([A-Za-z_]+):("[^"]*"|[^\s()]+)|("[^"]*"|[^\s()]+))')


def parse(text: str):
    """The tree of a query; terms side by side mean AND, NOT binds tightest, OR loosest."""
    if text.count('"') % 2:
        raise ValueError("quotes aren't balanced")
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read the query at {text[at:at + 20]!r}")
        tokens.append(m.groups())
        at = m.end()
    tree, rest = _either(tokens, 0)
    if rest != len(tokens):
        raise ValueError("parentheses aren't balanced")
    return tree


def _bare(s: str) -> str:
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] == '"' else s


def _either(tokens: list, at: int):
    parts = []
    while True:
        part, at = _all(tokens, at)
        parts.append(part)
        if at < len(tokens) and tokens[at][2] == "OR":
            at += 1
            continue
        return (parts[0] if len(parts) == 1 else Or(tuple(parts))), at


def _all(tokens: list, at: int):
    parts = []
    while at < len(tokens) and not tokens[at][1] and tokens[at][2] != "OR":
        if tokens[at][2] == "AND":
            if not parts or at + 1 == len(tokens):
                raise ValueError("AND needs a term on both sides")
            at += 1
            continue
        part, at = _one(tokens, at)
        parts.append(part)
    if not parts:
        raise ValueError("a term is missing")
    return (parts[0] if len(parts) == 1 else And(tuple(parts))), at


def _one(tokens: list, at: int):
    if at >= len(tokens):
        raise ValueError("a term is missing")
    opened, _, word, ranged, low, high, name, value, bare = tokens[at]
    if word == "NOT":
        part, at = _one(tokens, at + 1)
        return Not(part), at
    if opened:
        part, at = _either(tokens, at + 1)
        if at >= len(tokens) or not tokens[at][1]:
            raise ValueError("parentheses aren't balanced")
        return part, at + 1
    if ranged:
        ends = [None if _bare(x) == "*" else _bare(x) for x in (low, high)]
        return Term(ranged.upper(), low=ends[0], high=ends[1], is_range=True), at + 1
    if name:
        return Term(name.upper(), _bare(value)), at + 1
    if bare:
        return Term(None, _bare(bare)), at + 1
    raise ValueError("a term is missing")


def compiled(tree, fields: dict[str, Field] = FIELDS, default_text: tuple[str, ...] = DEFAULT_TEXT) -> Column:
    """The predicate of a query tree; what a null leaves open is false."""
    if isinstance(tree, And | Or):
        out = compiled(tree.parts[0], fields, default_text)
        for part in tree.parts[1:]:
            other = compiled(part, fields, default_text)
            out = out & other if isinstance(tree, And) else out | other
        return out
    if isinstance(tree, Not):
        return ~compiled(tree.part, fields, default_text)
    if tree.name is None:
        out = F.lit(False)
        for c in default_text:
            out = out | holds(F.col(c), tree.value)
        return out
    if tree.name not in fields:
        raise ValueError(f"unknown field {tree.name}")
    f = fields[tree.name]
    c = F.col(f.column)
    if tree.is_range or f.kind == "number":
        low, high = (tree.low, tree.high) if tree.is_range else (tree.value, tree.value)
        number = c.try_cast("double")
        out = number.isNotNull()
        if low is not None:
            out = out & (number >= float(low))
        if high is not None:
            out = out & (number <= float(high))
    elif f.kind == "flag":
        yes = F.upper(c.cast("string")).isin("Y", "TRUE")
        out = yes if tree.value.lower() in ("y", "yes", "true") else ~yes
    elif f.kind == "exact":
        out = F.lower(c.cast("string")) == tree.value.lower()
    else:
        out = holds(c, tree.value)
    return F.coalesce(out, F.lit(False))


def holds(c: Column, value: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(value.lower())), F.lit(False))


def search(papers: DataFrame, query: str) -> DataFrame:
    return papers.where(compiled(parse(query)))


def cites(papers: DataFrame, citations: DataFrame, dst: object) -> DataFrame:
    """Papers with an edge to ``dst`` in the citation table (src, dst)."""
    return papers.join(citations.where(F.col("dst") == dst).select(F.col("src").alias("id")), "id", "left_semi")


def evaluate(labelled: DataFrame, query: str, relevant: str = "relevant") -> DataFrame:
    """Recall, precision and F1 of a query against labels 0 and 1 in one pass; rows without a label don't count."""
    hit = compiled(parse(query), FIELDS, ("title",))
    good = F.col(relevant) == 1
    s = labelled.where(F.col(relevant).isNotNull()).agg(F.count_if(hit & good).alias("tp"), F.count_if(hit & ~good).alias("fp"), F.count_if(~hit & good).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    r, p = share(F.col("tp"), F.col("tp") + F.col("fn")), share(F.col("tp"), F.col("tp") + F.col("fp"))
    return s.select("tp", "fp", "fn", r.alias("recall"), p.alias("precision"), F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0).alias("f1_score"))


def quoted(term: str) -> str:
    """The term, in quotes if it holds spaces, special characters or operators."""
    special = re.search(r'[\s():\[\]{}"^~*?\\/+-]|AND|OR|NOT', term)
    return '"' + term.replace('"', "") + '"' if special else term


@dataclass
class Query:
    """Builds a query string part by part."""

    parts: list[str] = field(default_factory=list)
    waiting: bool = False

    def _add(self, text: str) -> Query:
        self.parts.append(text)
        self.waiting = False
        return self

    def keyword(self, term: str, name: str | None = None) -> Query:
        if not term.strip():
            raise ValueError("a term is empty")
        return self._add(f"{name.upper()}:{quoted(term)}" if name else quoted(term))

    def field(self, name: str, value: object) -> Query:
        if name.upper() not in FIELDS:
            raise ValueError(f"unknown field {name}")
        text = ("y" if value else "n") if isinstance(value, bool) else str(value) if isinstance(value, int) else quoted(str(value))
        return self._add(f"{name.upper()}:{text}")

    def years(self, first: int | None = None, last: int | None = None) -> Query:
        now = datetime.date.today().year
        first, last = 1000 if first is None else first, now if last is None else last
        if not 1000 <= first <= last <= now + 1:
            raise ValueError("years are out of order or range")
        return self._add(f"(PUB_YEAR:[{first} TO {last}])")

    def citations(self, least: int | None = None, most: int | None = None) -> Query:
        if min(least or 0, most or 0) < 0 or (least is not None and most is not None and least > most):
            raise ValueError("citation counts are negative or out of order")
        return self._add(f"(CITED:[{'*' if least is None else least} TO {'*' if most is None else most}])")

    def pmcid(self, number: str) -> Query:
        return self._add("PMCID:" + ("" if number.upper().startswith("PMC") else "PMC") + number.upper())

    def source(self, name: str) -> Query:
        return self._add(f"SRC:{name.upper()}")

    def accession_type(self, name: str) -> Query:
        """Works that name accessions of a database, such as pdb."""
        if not name.strip():
            raise ValueError("an accession type is empty")
        return self._add(f"ACCESSION_TYPE:{name.strip().lower()}")

    def _join(self, word: str) -> Query:
        if word != "NOT" and (not self.parts or self.waiting):
            raise ValueError(f"{word} needs a term before it")
        self.parts.append(word)
        self.waiting = True
        return self

    def and_(self) -> Query:
        return self._join("AND")

    def or_(self) -> Query:
        return self._join("OR")

    def not_(self) -> Query:
        return self._join("NOT")

    def group(self, other: Query) -> Query:
        return self._add(f"({other.build()})")

    def raw(self, text: str) -> Query:
        return self._add(text)

    def build(self) -> str:
        if not self.parts or self.waiting:
            raise ValueError("the query is empty or ends with an operator")
        text = " ".join(self.parts)
        parse(text)
        return text


def as_pubmed(tree) -> str:
    """A query tree in the syntax that puts field tags behind terms."""
    tags = {"TITLE": "ti", "ABSTRACT": "ab", "AUTH": "au", "JOURNAL": "ta", "PUB_YEAR": "dp", "AFF": "ad"}
    if isinstance(tree, And | Or):
        return "(" + (" AND " if isinstance(tree, And) else " OR ").join(map(as_pubmed, tree.parts)) + ")"
    if isinstance(tree, Not):
        return f"NOT {as_pubmed(tree.part)}"
    value = f"{tree.low or '1000'}:{tree.high or '3000'}" if tree.is_range else quoted(tree.value)
    return value + (f"[{tags.get(tree.name, tree.name.lower())}]" if tree.name else "[tiab]")
