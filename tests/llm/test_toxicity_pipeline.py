"""Toxicity by held-out labels, and the pipeline stage by stage."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import mixing, toxicity as t
from folioscope.llm.common import materialize
from tests.llm import test_ngram_join, test_secret_scan, test_tokens
from tests.llm.cases import TEXTS, documents, rows_of, table


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    w = np.array([3.0, 2.0, 1.0, 0.0, -2.0])
    rows = [np.flatnonzero(rng.random(5) < 0.5) for _ in range(1500)]
    z = np.array([w[r].sum() for r in rows]) + rng.logistic(size=1500)
    grades = (z > 1).astype(int) + (z > 3.5)
    found, thresholds = t.fit_ordinal(rows, grades, 5, 2)
    assert thresholds[0] < thresholds[1]
    assert np.corrcoef(found, w)[0, 1] > 0.97
    model = t.Model(dict(enumerate(found)), tuple(thresholds))
    assert 0 <= model.expected(-50) < model.expected(0) < model.expected(50) <= 2


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    even, odd = (labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)) == k) for k in (0, 1))  # no choice was made on this split
    scored = t.score(docs, t.fit(t.labelled_documents(docs, even)))
    held = scored.join(odd.where("toxic is not null"), "doc_id").select("rejected", "toxic").collect()
    toxic = [r.rejected for r in held if r.toxic]
    clean = [r.rejected for r in held if not r.toxic]
    assert toxic and sum(toxic) >= 0.9 * len(toxic)
    assert sum(clean) <= 0.02 * len(clean)


def test_grades_of_more_than_two_levels(spark):
    """Labels with grades 0, 1 and 2 give two thresholds and severities in their order; severities agree with brute force."""
    rng = np.random.default_rng(4)
    plain, mild, severe = ([f"{name}{''.join(chr(97 + c) for c in rng.integers(0, 26, 6))}" for _ in range(n)] for name, n in (("plain", 60), ("mild", 6), ("severe", 6)))
    rows, labels = [], []
    for i in range(900):
        grade = int(rng.choice([0, 0, 0, 1, 2]))
        words = list(rng.choice(plain, 30)) + list(rng.choice(mild, 2 * (grade > 0))) + list(rng.choice(severe, 2 * (grade > 1)))
        rows.append((i, " ".join(rng.permutation(words)), "en", "s", 0))
        labels.append((i, grade))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = t.fit(t.labelled_documents(docs, spark.createDataFrame(labels[:600], "doc_id long, toxic int")))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    found = {r.doc_id: r for r in t.score(docs, model).collect()}
    for i, text, *_ in rows:
        total = sum(model.weights.get(k, 0.0) for k in t.text_keys(set(text.split())))
        assert abs(found[i].severity - sum(1 / (1 + np.exp(x - total)) for x in model.thresholds)) < 1e-9
        assert found[i].rejected == (found[i].severity >= t.REJECT)
    of = lambda g: [found[i].severity for i, x in labels[600:] if x == g]
    assert np.mean(of(0)) < 0.2 and 0.7 < np.mean(of(1)) < 1.3 < 1.6 < np.mean(of(2))


def test_scores_of_the_table(spark, sf):
    """Each document's severity against the model's formula over its whole text."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = t.fit(t.labelled_documents(docs, labels))
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    for r in t.score(docs, model).collect():
        total = sum(model.weights.get(k, 0.0) for k in t.text_keys(set(re.findall(r"[^\W\d_]+", texts[r.doc_id].lower()))))
        assert abs(r.severity - sum(1 / (1 + np.exp(x - total)) for x in model.thresholds)) < 1e-9


def test_edges(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    found = rows_of(t.toxicity_report(docs, labels))
    assert [r[0] for r in found] == list(range(1, len(TEXTS) + 1)) and not any(r[2] for r in found)
    assert t.toxicity_report(documents(spark, []), labels).collect() == []
    assert not any(r.rejected for r in t.toxicity_report(docs, labels.limit(0)).collect())
    model = t.Model({k: 9.0 for k in t.feature_keys("venom")}, (1.0, 2.0))
    mixed = documents(spark, ["Venom!", "venom", "calm", None, ""], ids=[1, 1, None, 2, 3], extra=True)
    kept = t.keep_clean(mixed, model)
    assert kept.schema == mixed.schema
    assert rows_of(kept, "doc_id", "text") == [(None, "calm"), (2, None), (3, "")]
    assert [(r[0], r[2]) for r in rows_of(t.score(mixed, model))] == [(None, False), (1, True), (1, True), (2, False), (3, False)]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    (_, toxic), (_, near), (_, secrets), (_, mix), (_, encode) = corpus_pipeline.STAGES
    clean = materialize(toxic(spark, docs, sf), "test")
    report = {r.doc_id: r.rejected for r in t.toxicity_report(docs, table(spark, sf, "labels")).collect()}
    assert clean.schema == docs.schema
    assert rows_of(clean, "doc_id") == sorted((i,) for i, bad in report.items() if not bad)

    unique = materialize(near(spark, clean, sf), "test")
    brute = test_ngram_join.brute([(r.doc_id, r.text) for r in clean.collect()], 5, 80, 100)
    assert unique.schema == docs.schema and rows_of(unique, "doc_id") == [(i,) for i, n, c in brute if i == c]
    assert rows_of(unique) == rows_of(clean.join(unique.select("doc_id"), "doc_id", "left_semi"))

    hidden = materialize(secrets(spark, unique, sf), "test")
    assert hidden.schema == docs.schema
    assert rows_of(hidden, "doc_id", "text") == sorted((r.doc_id, test_secret_scan.redacted(r.text)) for r in unique.collect())

    mixed = materialize(mix(spark, hidden, sf), "test")
    assert mixed.schema == docs.schema
    copies = {r.doc_id: r.taken // max(1, r.size) for r in mixing.mix_report(hidden).collect() if r.size}
    rows = [r for r in mixed.collect() if r.text and r.text.strip()]
    assert sorted(r.doc_id for r in rows) == sorted(i for i, n in copies.items() for _ in range(n))

    final = rows_of(encode(spark, mixed, sf))
    assert final == sorted(test_tokens.coded(r.doc_id, r.text) for r in mixed.collect())
    assert rows_of(corpus_pipeline.run(spark, sf)) == final
    assert any(hashlib.sha256(b"").hexdigest() != r[3] for r in final)


def test_stages_on_odd_rows(spark, tmp_path):
    ids = [*range(1, len(TEXTS) + 1), *[None] * 5, 1, 6, 6, 3]  # null and repeated ids, of equal and of other texts
    for name, docs in (("odd", documents(spark, TEXTS + TEXTS[:9], ids=ids, extra=True)), ("none", documents(spark, [], extra=True))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
        assert (out.count() > 0) == (name == "odd")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            kept = f(spark, docs, folder)
            assert kept.schema == docs.schema, stage


def test_texts_go_to_python_in_small_batches(spark, sf):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.encode_texts):
            spark.conf.set(setting, 10_000)
            stage(spark, table(spark, sf, "documents"), sf)
            assert int(spark.conf.get(setting)) <= 2_000
            spark.conf.set(setting, 50)
            stage(spark, table(spark, sf, "documents"), sf)
            assert int(spark.conf.get(setting)) == 50
    finally:
        spark.conf.set(setting, before)
