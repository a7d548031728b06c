"""Findings of round 3: picked nodes, mentions without keys, facts and pairs in bounded tasks."""

from pyspark.sql import functions as F

from folioscope.operators import articles, identity, nodes

XML = """<!DOCTYPE article><article article-type='r'><front><publisher><publisher-name>P <i>Q</i></publisher-name></publisher><subj-group subj-group-type='h'><subject>A</subject><subj-group><subject>B</subject></subj-group></subj-group>
<contrib><name><surname>S</surname><given-names>G</given-names></name><xref ref-type='aff' rid='a1'/></contrib><aff id='a1'><sup>1</sup> Uni A, Rome, Italy</aff></front>
<body><table-wrap><table><tr><th>h<sup>2</sup></th><td/></tr></table></table-wrap></body><back><ref id='r'><person-group><name><surname>Z</surname></name></person-group><article-title>T</article-title></ref></back></article>"""


def test_picked_nodes_are_enough(spark):
    docs = spark.createDataFrame([(1, XML), (2, None), (3, "<a/>"), (4, "<a>"), (5, XML.replace("<body>", "<body><x:p>&amp;</x:p>"))], "k int, xml string")
    whole = nodes.shred(docs, "k", "xml")
    for name, tags in articles.TAGS.items():
        picked = nodes.shred(docs, "k", "xml", tags)
        made = getattr(articles, name)
        assert sorted(map(str, made(picked).collect())) == sorted(map(str, made(whole).collect())), name
        assert picked.where("tag is not null").where((F.col("pre") > 0) & ~F.col("tag").isin(*tags)).isEmpty()
        assert picked.where("error is not null").count() == 2
    assert [tuple(r) for r in articles.categories(whole).where("doc = 1").orderBy("pos").collect()] == [(1, 0, "r", "h", ["A"]), (1, 1, "r", None, ["B"])]
    plan = articles.categories(nodes.shred(docs, "k", "xml", articles.TAGS["categories"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # one look at the nodes


def test_mentions_without_keys_stay_alone_where_ids_clash(spark):
    rows = spark.createDataFrame([(1, "r1"), (1, None), (2, None), (3, ""), (4, "r1")], "mention long, ror string")
    found = identity.resolved(rows, "mention", {"ror": F.col("ror")})
    assert sorted((r.mention, r.ror or "", r.entity) for r in found.collect()) == [(1, "", 1), (1, "r1", 1), (2, "", 2), (3, "", 3), (4, "r1", 1)]


def test_fuzzy_pairs_as_defined_and_normalised_once(spark, sf):
    from folioscope.functions import text
    from folioscope.plans import mined

    words = ["alpha", "beta", "gama", "gamma", "delt", "delta", "x"]
    texts = [" ".join(words[(i * k + k) % 7] for k in range(1 + i % 4)) for i in range(30)] + [""]
    for a in texts[:-1]:
        for b in texts[:-1]:
            x, y = set(a.split()), set(b.split())
            said = a in b or b in a or len(x & y) / len(x | y) >= 0.5 or text.token_set_score(a, b) >= 85
            assert text.matches(a, b, 0.5, 85.0) == said, (a, b)
    rows = spark.createDataFrame([("a b", [None, "", "b a"]), ("", ["a"]), (None, ["a"]), ("a", None), ("a", ["zzz"])], "n string, h array<string>")
    assert [r[0] for r in rows.select(text.any_match(F.col("n"), F.col("h"))).collect()] == [True, False, False, False, False]
    plan = mined.fuzzy_matches(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") < 40


def test_articles_are_parsed_in_pieces(spark):
    import pandas as pd

    from folioscope.operators import fulltext

    xml = pd.Series(["a" * 300_000] * 8 + [None] + ["b"] * 450 + ["c" * 2_000_000])
    pieces = list(fulltext.parts(xml))
    assert [x for p in pieces for x in p] == list(xml)
    assert all(len(p) <= fulltext.PART_ROWS and (len(p) == 1 or sum(len(x or "") for x in p) <= fulltext.PART_CHARS) for p in pieces)
    docs = spark.range(1000).selectExpr("id", "concat('<a><b>', id, '</b></a>') AS x")
    assert fulltext.tag_frequencies(fulltext.parse(docs, "id", "x")).orderBy("tag").collect() == [("a", 1000), ("b", 1000)]


def test_rows_meet_before_they_become_facts(spark):
    from folioscope.operators import entity_graph, graph, network

    rows = spark.createDataFrame([(1, "p", "T"), (1, "p", "T"), (2, "p", "U")], "id int, doi string, title string").selectExpr("*", "'' AS pmid", "'' AS pmcid", "'A' AS authors", "'1' AS year")
    made = entity_graph.references(rows, graph.F.concat(F.lit("x/"), F.col("id").cast("string")))
    assert made.count() == made.distinct().count() == 10
    heads = spark.createDataFrame([("1", "A", None, True, [("q", True)]), ("1", "A", "D", True, [("q", True)]), ("1", "?", None, False, [])], "p string, descriptor string, descriptor_id string, major boolean, qualifiers array<struct<name:string,major:boolean>>")
    found = entity_graph.headings(heads, F.col("p"))
    assert found.count() == found.distinct().count() == 10
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    papers = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a"), (None, "z"), (None, "y")], "paper int, author string")
    assert network.collaboration_pairs(papers).collect() == [("a", "b", 2)]
    assert graph.collaboration_links(papers).count() == 2
    network_pairs, network.PAIRS = network.PAIRS, 1
    try:
        assert network.shared_papers(spark.range(30).selectExpr("1 AS paper", "id AS author")).rdd.getNumPartitions() == 436
    finally:
        network.PAIRS = network_pairs
