import math
import zlib

import pytest
import zstandard

from changelens.llm import quality_classifier as qc
from changelens.llm.queries import op10_quality_classifier

from .conftest import LONG, ODD

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL").collect()
    truth = {r["doc_id"]: r["quality"] for r in labels}
    rows = op10_quality_classifier(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    good = [r["predicted"] for r in held if truth[r["doc_id"]] == 1]
    bad = [r["predicted"] for r in held if truth[r["doc_id"]] == 0]
    assert len(held) > 500 and sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.15


@pytest.fixture(scope="module")
def model():
    good = [(f"a calm text number {i} with some plain words about the weather and the sea {i * 7}", 1) for i in range(300)]
    bad = [(f"BUY!! NOW!! {i} $$$ CHEAP!! {i * 3} %%% DEAL!!", 0) for i in range(300)]
    return qc.fit(good + bad)


def test_fit_and_score(model):
    assert qc.score("plain words about the sea and a calm text", model) > 0.5 > qc.score("CHEAP!! BUY!! 7 $$$ NOW!!", model)
    assert model == qc.fit([(f"a calm text number {i} with some plain words about the weather and the sea {i * 7}", 1) for i in range(300)]
                           + [(f"BUY!! NOW!! {i} $$$ CHEAP!! {i * 3} %%% DEAL!!", 0) for i in range(300)])


def test_odd_rows(odd, empty, model):
    rows = {r["doc_id"]: r for r in qc.classified(odd, model).collect()}
    assert rows[1]["score"] == rows[2]["score"] == 0.0 and rows[5]["score"] == rows[6]["score"] and not rows[None]["held_out"]
    assert qc.classified(odd, model).count() == len(ODD) and qc.classified(empty, model).count() == 0
    assert qc.accepted(odd, model).columns == odd.columns
    assert qc.score(LONG, model) == rows[5]["score"]


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert qc.trained(odd, none) == qc.Model()
    one = spark.createDataFrame([(3, 1), (None, 0), (4, None)], "doc_id bigint, quality int")
    assert qc.trained(odd, one).dictionaries == ()


def by_definition(text, model):
    """The score from sizes of its own: fresh compressors, pieces of equal length, no shared code."""
    data = text.encode()
    count = max(1, round(len(data) / 1_000))
    step = -(-len(data) // count)
    pieces = [data[i : i + step] for i in range(0, len(data), step)]

    def sizes(dictionary):
        if dictionary is None:
            return [len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(p)) for p in pieces]
        known = zstandard.ZstdCompressionDict(dictionary)
        known.precompute_compress(level=3)
        return [len(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False).compress(p)) for p in pieces]

    bad, good, plain = sizes(model.dictionaries[0]), sizes(model.dictionaries[1]), sizes(None)
    x = [(sum(bad) - sum(good)) / (sum(bad) + sum(good)), min((b - g) / (b + g) for b, g in zip(bad, good)), min(1.0, sum(plain) / len(data))]
    z = model.weights[-1]
    for value, low, high, weight in zip(x, model.low, model.high, model.weights):
        z += weight * (min(max(value, low), high) - low) / (high - low)
    return 1 / (1 + math.exp(-min(max(z, -40), 40)))


def test_scores_by_definition(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    learned = qc.trained(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in qc.classified(docs, learned).collect():
        assert r["score"] == pytest.approx(by_definition(texts[r["doc_id"]], learned) if texts[r["doc_id"]] else 0.0, abs=1e-9)


def test_one_row_of_an_id_is_learned_from(spark, make, monkeypatch):
    docs = make([(1, f"text {i:03}") for i in range(50)] + [(2, "good text"), (3, "bad text"), (4, "other")])
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(qc, "fit", lambda texts: seen.extend(texts))
    qc.trained(docs, labels)
    known = {1: "text 000", 2: "good text", 3: "bad text", 4: "other"}
    assert sorted(seen) == sorted((t, i % 2) for i, t in known.items() if zlib.crc32(str(i).encode()) % 5)
