import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from changelens.llm import bpe
from changelens.llm.queries import op2_bpe

from .conftest import ODD

SIGNS = " \n\t\r\x0b\x0c\x1c\x85\xa0 abcAB'stréßñ日本語한1٣²Ⅷ½_-.,!😀́​\x00"


@pytest.fixture(scope="module")
def own():
    return bpe.encoder()


@pytest.fixture(scope="module")
def public(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_any_signs_as_the_public_library(own, public):
    rng = random.Random(3)
    for _ in range(4_000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40)))
        assert own.encode(text) == public.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_ids_that_are_no_tokens(own):
    assert own.decode([]) == b"" and own.decode([0, 5]) == own.token[0] + own.token[5]
    for ids in ([-1], [max(own.token) + 1]):
        with pytest.raises((ValueError, IndexError)):
            own.decode(ids)


def test_long_pieces(own, public):
    rng = random.Random(4)
    for text in ("a" * 5_000, "ab" * 3_000, " " * 2_000, "".join(rng.choice("etaoin") for _ in range(20_000))):
        assert own.encode(text) == public.encode_ordinary(text)


def test_appended_bytes_leave_earlier_entries(own):
    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.choice(b"etaoinshr ") for _ in range(rng.randint(1, 60)))
        cut = rng.randint(0, len(data))
        first = own.extend(b"", [-1], data[:cut])
        joined, last = own.extend(*first, data[cut:])
        assert last[: cut + 1] == first[1]
        assert [own.read_back(last, end) for end in range(len(joined) + 1)] == [own.merged(data[:end]) for end in range(len(data) + 1)]


def test_edits_encode_little_and_stay_right(own, public):
    rng = random.Random(6)
    text = "some words in a row " * 50
    edited = bpe.EditableText(own, text)
    for _ in range(300):
        at = rng.randint(0, len(text))
        end, new = min(len(text), at + rng.randint(0, 5)), "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 5)))
        changed = edited.replace(at, end, new)
        text = text[:at] + new + text[end:]
        assert edited.text == text and edited.ids() == public.encode_ordinary(text) and changed < 40
    edited.append(" end")
    assert edited.ids() == public.encode_ordinary(text + " end")


def test_small_memory_gives_the_same_ids(own, public, monkeypatch):
    for name in ("PIECES", "CHUNKS", "PAIRS"):
        monkeypatch.setattr(bpe, name, 3)
    small = bpe.PrefixEncoder(own.ranks)
    text = "a row of different words, and the same words once more"
    assert small.encode(text) == public.encode_ordinary(text)


def test_odd_rows_and_empty_table(odd, empty, public):
    rows = bpe.encode_documents(odd).collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"]), bytes(r["decoded"])) for r in rows) == sorted(
        (i or 0, public.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD
    )
    assert bpe.encode_documents(empty).count() == 0
    assert odd.select(bpe.decode(F.lit(None).cast("array<int>")).alias("x")).where("x IS NOT NULL").count() == 0


def test_query(spark, public):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op2_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = public.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
