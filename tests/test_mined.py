"""Places, citations, fuzzy matching and identities: odd rows and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import places, text
from folioscope.operators import citations, identity, search_entities
from folioscope.plans.mined import fuzzy_matches
from folioscope.plans.views import view


def test_institution(spark):
    rows = {
        "Dept of X, Univ Y, San Francisco, CA 94103, USA": ("Dept of X, Univ Y", "San Francisco", "CA", "94103", "USA"),
        "Uni B, Sydney, NSW, 2000, Australia": ("Uni B", "Sydney", "NSW", "2000", "Australia"),
        "Uni C, Toronto, ON M5S 1A1, Canada": ("Uni C", "Toronto", None, "ON M5S 1A1", "Canada"),
        "94103, Uni G, Town, Republic of X": ("Uni G", "Town", None, "94103", "Republic of X"),
        "Uni F, Berlin, DE.": ("Uni F", "Berlin", None, None, "DE"), "Inst D": ("Inst D", None, None, None, None), "City, 94103": ("City", None, None, "94103", None),
        "": (None,) * 5, " , ,": (None,) * 5, "CA": (None, None, None, None, "CA"), "A, TX, TX": ("A", "TX", "TX", None, None),
    }
    df = spark.createDataFrame([(k, "clash") for k in rows] + [(None, "clash")], "text string, name string")
    found = {r.text: tuple(r.x)[1:] for r in df.select("text", places.institution(F.col("text")).alias("x")).collect()}
    assert found == rows | {None: (None,) * 5}


def test_institutions_of_one_text(spark):
    df = spark.createDataFrame([("Uni A, Paris, France And Uni B, Oslo, 0150, Norway. Tel: 5", ["a", "b"]), ("Uni A and , and B", ["a", "x", "c"]), (None, None), ("", ["a"])], "t string, m array<string>")
    found = [r.x for r in df.select(places.institutions(F.col("t"), F.col("m")).alias("x")).collect()]
    assert [(i.marker, i.name, i.city, i.country) for i in found[0]] == [("a", "Uni A", "Paris", "France"), ("b", "Uni B", "Oslo", "Norway")]
    assert [(i.marker, i.name) for i in found[1]] == [("a", "Uni A"), ("c", "B")] and not found[2] and not found[3]


def test_citation_fields(spark):
    texts = [
        "Smith J, Doe A, et al.  A title of a paper. Journal of Things. 2001;12:345-678. doi:10.1/abc. PMID: 123", "Smith J. Some title (2003) in J. 12(1999)", "Doe J et al. Only words. J Bio 12, 345 https://doi.org/10.5/x,",
        "Smith J. Title? Journal 1999", "NOTHING", "", "  ", None,
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, __d string")
    found = {r.id: tuple(r)[3:] for r in citations.with_fields(df).collect()}
    assert found == {
        0: ("Smith J, Doe A", "A title of a paper", "Journal of Things", "2001", "12", "345-678", "10.1/abc", "123", None), 1: ("Smith J", "Some title", None, "2003", "12", None, None, None, "in J. 12(1999)"),
        2: ("Doe J", "Only words", "J Bio", None, "12", "345", "10.5/x", None, None), 3: ("Smith J", None, None, "1999", None, None, None, None, "Title? Journal 1999"), 4: (None,) * 8 + ("NOTHING",), 5: (None,) * 9, 6: (None,) * 9, 7: (None,) * 9,
    }


def plain(x):
    return " ".join(re.sub(r"[^\w\s]", " ", x.lower()).split())


def test_cited_papers_against_all_pairs(spark):
    rng = random.Random(4)
    titles = [" ".join(rng.choice(["Red", "blue", "green-leaf", "Set", "Map"]) for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["", None]
    papers = [(i, t, rng.choice(["1999", "2001", "", None])) for i, t in enumerate(titles)]
    cites = [(i, rng.choice([f"Roe A. {rng.choice(titles)}. J. {y};1:2", f"Roe A. {rng.choice(titles)} ({y})", f"{rng.choice(titles)}? {rng.choice(titles)}. {y}", "none", "", None])) for i in range(300) for y in [rng.choice((1999, 2001, 1950))]]
    found = {r.id: (r.paper, r.year_agrees) for r in citations.cited_papers(spark.createDataFrame(cites, "id int, text string"), spark.createDataFrame(papers, "id int, title string, pubYear string")).collect()}
    expected = {}
    for i, t in cites:
        parts = [p for p in re.split(r"[.?!]\s+|\s*\(\s*\d{4}\s*\)\.?\s*", " ".join((t or "").split())) if p]
        cuts = {plain(p) for p in parts} | {plain(f"{a} {b}") for a, b in zip(parts, parts[1:])}
        years = set(re.findall(citations.YEAR, t or ""))
        hits = [(y not in years, -len(plain(p)), k) for k, p, y in papers if p and plain(p) in cuts]
        if hits:
            expected[i] = (min(hits)[2], not min(hits)[0])
    assert found == expected and len(found) > 100


def quadratic(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def set_score(a, b):
    """The definition, by the quadratic table."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 100.0
    sides = [" ".join([common, *sorted(z)]).strip() for z in (x - y, y - x)]
    pairs = [tuple(sides)] + [(common, s) for s in sides if common]
    return max(200.0 * quadratic(p, q) / (len(p) + len(q)) for p, q in pairs)


def random_text(rng, most=8):
    return " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, most)))


def test_common_subsequences_and_scores():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = random_text(rng, 30), random_text(rng)
        assert text.common_length(a, b) == quadratic(a, b) and text.token_set_score(a, b) == pytest.approx(set_score(a, b))
    assert text.common_length("x" * 5_000, "y" * 9_000 + "x") == 1 and text.common_length("", "a") == 0


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a and b else 0.0


def match(n, hay):
    return bool(n) and any(h and (h in n or n in h or set_score(n, h) >= 85 or jaccard(n, h) >= 0.5) for h in hay or [])


def test_any_match_and_bounds(spark):
    rng = random.Random(2)
    rows = [(i, random_text(rng), [random_text(rng) for _ in range(rng.randint(0, 3))]) for i in range(1200)]
    rows += [(-1, None, ["a"]), (-2, "a", None), (-3, "a", [None, ""]), (-4, "abcdefghij", ["abcdefghix"]), (-5, "", [""])]
    df = spark.createDataFrame(rows, "i int, n string, h array<string>")
    found = {r.i: r for r in df.select("i", text.any_match(F.col("n"), F.col("h")).alias("one"), text.all_needles_match([F.col("n"), F.lit("ab")], F.col("h")).alias("all"), text.any_needles_match([F.col("n"), F.lit("ab")], F.col("h")).alias("any"), text.any_match(F.col("n"), F.col("h"), fuzzy=None).alias("plain")).collect()}
    for i, n, h in rows:
        assert found[i].one == match(n, h) and found[i].all == (match(n, h) and match("ab", h)) and found[i]["any"] == (match(n, h) or match("ab", h)), (n, h)
        assert found[i].plain <= found[i].one
    pairs = df.select("n", F.explode("h").alias("x")).where("x is not null").select("n", "x", text.token_set_bounds(F.col("n"), F.col("x")).alias("b")).collect()
    assert all(p.b.low - 1e-9 <= set_score(p.n, p.x) <= p.b.high + 1e-9 for p in pairs)


def test_fuzzy_matches_query(spark, sf):
    """All rows of the query against the quadratic definition."""
    papers = {r.id: r for r in view(spark, sf, "papers").select("id", "title", "journalTitle", "abstractText").collect()}
    flip = str.maketrans("EI", "IE")
    for r in fuzzy_matches(spark, sf).collect():
        p = papers[r.id]
        slip = p.title[1:] + " x" if r.id % 3 == 0 else p.title.translate(flip) if r.id % 3 == 1 else "on " + p.title[:9]
        assert r.in_title == match(plain(slip), [plain(p.title)]) and r.elsewhere == match(plain(slip), [plain(p.journalTitle), plain(p.abstractText)])


def test_resolved_by_union_find(spark):
    rng = random.Random(3)
    rows = [(i, f"a{rng.randrange(150)}" if rng.random() < 0.4 else None, f"b{rng.randrange(150)}" if rng.random() < 0.5 else "", "clash") for i in range(400)]
    rows += [(1000 + i, f"c{i}", f"d{i}", "x") for i in range(60)] + [(2000 + i, f"c{i + 1}", f"d{i}", "x") for i in range(60)] + [(3000, None, None, "x"), (3001, None, None, "x")]  # a long chain
    df = spark.createDataFrame(rows, "id long, a string, b string, node string")
    found = {r.id: r.entity for r in identity.resolved(df, "id", {"a": F.col("a"), "b": F.col("b")}).collect()}
    up = {r[0]: r[0] for r in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k in (1, 2):
        first = {}
        for r in rows:
            if r[k]:
                i, j = sorted((root(r[0]), root(first.setdefault(r[k], r[0]))))
                up[j] = i
    assert found == {r[0]: root(r[0]) for r in rows} and found[2059] == 1000
    assert identity.resolved(df.where("false"), "id", {"a": F.col("a")}).collect() == []
    told = {r.entity: (r.mentions, r.a) for r in identity.described(identity.resolved(df, "id", {"a": F.col("a"), "b": F.col("b")}), ["a"]).collect()}
    assert told[1000] == (120, "c1") and told[3000] == (1, None)


def test_search_records_of_odd_shapes(spark):
    odd = [
        ("1", '{"authorList":{"author":[{"fullName":"A","authorId":{"type":"ORCID","value":"o1"}},{"fullName":"B"},{"fullName":"C"}]},"authorIdList":{"authorId":[{"type":"X","value":"n"},{"type":"ORCID","value":"o2"}]},"keywordList":{"keyword":["a","b"]}}'),
        ("2", '{"keywordList":{"keyword":"one"},"meshHeadingList":{"meshHeading":[{"descriptorName":"D","majorTopic_YN":"Y"},{"majorTopic_YN":"Y"}]}}'),
        ("3", '{"keywordList":{"keyword":{"x":1}},"authorList":{}}'), ("4", "{}"), ("5", "not json"), ("6", None), ("7", ""),
    ]
    found = search_entities.records(spark.createDataFrame(odd, "id string, json string"))
    assert [(r.id, r.pos, r.full_name, r.orcid) for r in search_entities.authors(found).orderBy("id", "pos").collect()] == [("1", 0, "A", "o1"), ("1", 1, "B", "o2"), ("1", 2, "C", None)]
    assert [(r.id, r.keyword) for r in search_entities.keywords(found).orderBy("id", "pos").collect()] == [("1", "a"), ("1", "b"), ("2", "one"), ("2", "MeSH:D")]
    assert [(r.id, r.full_term, r.major) for r in search_entities.headings(found).collect()] == [("2", "D", True)]
    assert search_entities.papers(found).count() == 7 and search_entities.grants(found).collect() == [] and search_entities.institutions(search_entities.authors(found)).collect() == []


def test_normal_forms(spark):
    from folioscope.functions import entities

    people = spark.createDataFrame([(" A ", None, "0000-0001-0002-000x", "X@Y.ORG ", "clash"), (None, " ", "bad", "no mail", "clash")], "full_name string, first_name string, orcid string, email string, note string")
    assert [tuple(r) for r in entities.normalized(people, "author").collect()] == [("A", None, "0000-0001-0002-000X", "x@y.org", "clash"), ("", "", None, None, "clash")]
    rows = spark.createDataFrame([([" a ", "", None, "b"],), ([],), (None,)], "cells array<string>")
    assert [r.cells for r in entities.normalized(rows, "table_row").collect()] == [["a", "b"], [], None]
    assert [r.errors for r in entities.with_errors(rows, "table_row").collect()] == [[], ["needs cells"], ["needs cells"]]
    grants = spark.createDataFrame([(" d ", None)], "fundref_doi string, award_id string")
    assert [tuple(r) for r in entities.normalized(grants, "grant").collect()] == [("d", None)]


def test_subject_terms_and_empty_sources(spark):
    from folioscope.operators import articles, nodes, record_graph

    odd = [("1", '{"title":" T ","keywordList":{"keyword":["k1"," "]},"meshHeadingList":{"meshHeading":[{"descriptorName":""}]}}'), ("2", '{"keywordList":{"keyword":"k2"},"meshHeadingList":{"meshHeading":[{"descriptorName":"A B"}]}}'), ("3", "broken"), ("4", None), ("5", "{}")]
    found = record_graph.search_graph(search_entities.records(spark.createDataFrame(odd, "id string, json string"))).collect()
    terms = {(r.s[-1], r.o) for r in found if r.p.endswith("hasDescriptor")}
    assert terms == {("1", "k1"), ("2", "http://id.nlm.nih.gov/mesh/A_B")} and len(found) == len(set(found)) and {r.s[-1] for r in found if r.p.endswith("type")} >= {"1", "2", "5"}
    rows = nodes.shred(spark.createDataFrame([], "k int, xml string"), "k", "xml")
    for made in (articles.authors, articles.references, articles.cells, articles.categories, articles.publishers, articles.affiliations):
        assert made(rows).collect() == []


def test_articles_of_odd_shapes(spark):
    from folioscope.operators import articles, nodes

    xml = """<article><front><contrib-group><contrib><name><surname>Only</surname></name><xref ref-type="aff" rid="a2"/><xref ref-type="aff" rid="a1"/><xref ref-type="aff" rid="none"/></contrib><contrib contrib-type="author"><collab>No name</collab></contrib></contrib-group>
      <aff id="a1"><sup>1</sup>Uni A, Rome, Italy</aff><aff id="a2">Uni <b>B</b><sup>2</sup></aff><aff>no id</aff><publisher/><publisher><publisher-name>second</publisher-name></publisher></front>
      <body><table><tr><th>h</th><td/></tr></table><table-wrap><table><tr><td>1</td></tr><tr><td>2</td><td>3</td></tr></table></table-wrap></body>
      <back><ref-list><ref id="r1"><mixed-citation>Roe A. <source>Given</source></mixed-citation></ref><ref/></ref-list></back></article>"""
    rows = nodes.shred(spark.createDataFrame([(1, xml), (2, None), (3, "<a/>"), (4, "<a>")], "k int, xml string"), "k", "xml")
    assert [(r.name, r.orcid, r.affiliation_text, [i.name for i in r.institutions]) for r in articles.authors(rows).collect()] == [("Only", None, "Uni B; Uni A, Rome, Italy", ["Uni B", "Uni A"])]
    assert sorted((r.id or "", r.markers, r.text) for r in articles.affiliations(rows).collect()) == [("", [], "no id"), ("a1", ["1"], "Uni A, Rome, Italy"), ("a2", ["2"], "Uni B")]
    assert [tuple(r) for r in articles.publishers(rows).collect()] == [(1, None, None)]
    assert sorted(tuple(r)[1:] for r in articles.cells(rows).collect()) == [(0, 0, 0, True, "h"), (0, 0, 1, False, ""), (1, 0, 0, False, "1"), (1, 1, 0, False, "2"), (1, 1, 1, False, "3")]
    refs = {r.id: r for r in articles.references(rows).collect()}
    assert refs["r1"].source == "Given" and refs["r1"].authors == "Roe A" and refs[None].title is None
