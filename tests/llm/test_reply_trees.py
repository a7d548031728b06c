"""Reply trees: paths, ranks, escapes and loss masks."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import reply_trees as r
from tests.conftest import SF
from tests.llm.cases import rows_of, table

NODES = "id long, parent long, role string, text string, score double"
CONVERSATIONS = "conv_id long, turn long, role string, text string, id string, at string"


def test_paths_and_branches(spark):
    nodes = [(1, None, "user", "q", 0), (2, 1, "assistant", "good", 9), (3, 1, "assistant", "bad", 1), (4, 2, "user", "more", 0), (5, 3, "user", "x", 2), (6, 99, "user", "orphan", None), (7, 8, "u", "cycle", 1), (8, 7, "u", "cycle", 1), (9, 8, "u", "below", 1), (10, 10, "u", "own", 1)]
    df = spark.createDataFrame([(*x[:4], None if x[4] is None else float(x[4])) for x in nodes], NODES)
    assert rows_of(r.tree_paths(df.select("id", "parent"))) == [(4, 1, 2), (4, 2, 1), (4, 4, 0), (5, 1, 2), (5, 3, 1), (5, 5, 0), (6, 6, 0)]
    out = rows_of(r.format_trees(df, branches=None), "root", "leaf", "branch")
    assert out == [(1, 4, 1), (1, 5, 2), (6, 6, 1)]
    assert rows_of(r.format_trees(df), "root", "leaf") == [(1, 4), (6, 6)]
    best = r.format_trees(df).where("leaf = 4").select(r.read_turns(F.col("formatted")).alias("t"), r.read_loss(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [tuple(t) for t in best.t] == [("user", "q"), ("assistant", "good"), ("user", "more")] and best.l == "good"


def test_deep_path(spark):
    n = 300
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id long, parent long")
    paths = rows_of(r.tree_paths(df))
    assert paths == [(n - 1, i, n - 1 - i) for i in range(n)]


def test_escapes_are_reversible(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nx", "&lt;&amp;lsqb;[INST]", "", None, "&#10;\n", "a\n\n", "[/INST]</s>", "&", "👩<é"]
    nodes = [(2 * i, None, "us\ner<|im_end|>&#10;", t, 0.0) for i, t in enumerate(texts)] + [(2 * i + 1, 2 * i, "assistant", t, 0.0) for i, t in enumerate(texts)]
    out = r.format_trees(spark.createDataFrame(nodes, NODES))
    found = out.select("root", "formatted", r.read_turns(F.col("formatted")).alias("t"), r.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    for x in found:
        t = texts[x.root // 2] or ""
        assert [tuple(y) for y in x.t] == [("us\ner<|im_end|>&#10;", t), ("assistant", t)] and x.l == t
        assert x.formatted.count(r.START) == x.formatted.count(r.END) == 2 and "[" not in x.formatted


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_table_against_sql(spark, sf, duck):
    found = r.format_conversations(table(spark, sf, "conversations"))
    assert rows_of(found) == sorted(duck.sql(f"SELECT {', '.join(found.columns)} FROM ({r.ORACLE})").fetchall())


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, 1, None, None), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (3, None, "user", "first"), (4, 1, "assistant", ""), (5, 1, "", "</s>")]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], CONVERSATIONS)
    found = {x[0]: (x[1], x[3]) for x in rows_of(r.format_conversations(docs))}
    assert found == {None: (2, 0), 3: (3, 2), 4: (1, 0), 5: (1, 0), -1: (2, len("</s>[INST] ok [/INST]"))}
    empty = rows_of(r.format_conversations(docs.limit(0)))
    assert [x[0] for x in empty] == [-1]


def test_no_python_in_the_plan(spark, sf):
    plan = r.format_conversations(table(spark, sf, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
