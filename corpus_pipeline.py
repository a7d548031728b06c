"""A corpus pipeline over ``documents``: each stage reads what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``documents``, and further
ones with them, whatever their names. Every stage takes an empty table and gives one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import bpe_codec, mixing, ngram_join, secret_scan, toxicity
from folioscope.llm.common import materialize, text_batches

#: Near duplicates: five-word shingles that agree by 80 of 100 or more.
SHINGLE_WORDS, SIMILAR, OF = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grade model, fitted on labelled ones, doesn't reject.

    Rows are judged one by one by their text: null and empty ones stay, repeated ones share their fate. Without
    labels all stay; rows with a null id can't be labelled but are judged. A severity of just the bound goes.
    """
    text_batches(spark)
    labels = toxicity.sample_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.labelled_documents(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, null ids last, then by the text's hash.

    Texts without words (null, empty) all stay. Rows that agree in id and text are one document;
    different texts that share an id are documents of their own.
    """
    return ngram_join.keep_one(docs, SHINGLE_WORDS, SIMILAR, OF)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, row by row; null texts stay null, ``n_chars`` follows the text."""
    return secret_scan.redact(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null sources are one source.

    Rows alike in id, source and size are drawn as one; a text without words comes as often as all of its source
    do for certain; draws go by id and size, so reruns agree.
    """
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text for each row of the mix, repeated ones each time; null texts count as empty."""
    text_batches(spark)
    return bpe_codec.encode(docs, digest_only=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: SQL can't express the stages' models and rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
