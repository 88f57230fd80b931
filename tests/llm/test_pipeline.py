"""The pipeline against its stages done plainly on the driver."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from changelens.llm import bpe, mixing, quality_classifier

from .test_simhash import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_classifier.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.orderBy("doc_id").collect() if quality_classifier.score(r["text"], model) >= quality_classifier.THRESHOLD]
    first = {}
    for r in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r)
    rows = list(first.values())
    keep = {c for _, _, c in near_brute([(r["doc_id"], r["text"]) for r in rows])}
    rows = [r for r in rows if r["doc_id"] in keep]
    assert 20 < len(rows) < docs.count()
    public = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={}
    )
    times = {r["doc_id"]: r["n"] for r in mixing.mixed(spark.createDataFrame(rows, docs.schema)).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    want = sorted((r["doc_id"], public.encode_ordinary(r["text"] or "")) for r in rows for _ in range(times.get(r["doc_id"], 0)))
    got = sorted((r["doc_id"], list(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


def test_stages_pass_the_columns_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
