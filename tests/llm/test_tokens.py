import base64
import random

import public_tokenizers
import pytest
import tiktoken

from strandline.llm import tokens as t

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoder():
    return t.Encoder.from_file(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_same_ids_as_the_library(encoder, library):
    r = random.Random(4)
    alphabet = "aabcdeXYZ  \n\t\r0159.,=+/éüßжо中👩‍🔬​'" + "st"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(400)]
    texts += ["a" * 5000, " " * 300, "<|endoftext|>", "don't we'll", base64.b64encode(r.randbytes(3000)).decode()]
    offsets, flat = encoder.encode(texts)
    for x, a, b in zip(texts, offsets, offsets[1:]):
        assert flat[a:b].tolist() == library.encode_ordinary(x)


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i).encode() for i in range(3000)] + [b""]
    h = t.PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert h.find(keys) == list(range(len(keys))) and set(h.find([b"x", b"3001", b"-1"])) == {-1}
    assert t.PerfectHash([b"one"]).find([b"one", b"two"]) == [0, -1]


def test_forgetting_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(t, "REMEMBERED", 3)
    for x in ("one two three four", "five six seven", "one two three four"):
        assert encoder.encode([x])[1].tolist() == library.encode_ordinary(x)


def test_null_empty_and_repeated_rows(spark, library):
    rows = [(1, "Hello", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello", "x"), (None, "b c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, t.encode(df, "doc_id", "text", PATH, PATTERN).collect()), key=repr)
    assert got == sorted([(k, library.encode_ordinary(x or "")) for k, x, _ in rows], key=repr)
    assert t.encode(df.limit(0), "doc_id", "text", PATH, PATTERN).count() == 0
