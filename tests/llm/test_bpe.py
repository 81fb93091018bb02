"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from precis.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codecs():
    ranks = bpe.parse_ranks(bpe.read_ranks(PATH))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.ByteBpe(ranks, public_tokenizers.PATTERN), library


def texts():
    rng = random.Random(1)
    odd = "ab \t\n\x1c\x1f\x85\xa0　'sté½٣日😀.!\x00\x0b​"
    made = ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(400)]
    made += ["", " ", "<|endoftext|>", "don't we'll I'M", "a" * 5001, "ab" * 3000, " " * 999]
    made += ["".join(rng.choice("abcdefgh") for _ in range(20_000))]
    return made


def test_ids_equal_the_library(codecs):
    own, library = codecs
    for text, ids in zip(texts(), own.encode_batch(texts()), strict=True):
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_ranks_that_come_back_down(codecs):
    """Tables in which a merge makes a pair of lower rank than its own, in one piece and across pieces."""
    rng = random.Random(7)
    for _ in range(40):
        ranks = {bytes([b]): 100 + i for i, b in enumerate(b"abc ")}
        words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))).encode() for _ in range(14)})
        order = rng.sample(range(100), len(words))
        ranks |= dict(zip(words, order, strict=True))
        own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        sample = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(10)]
        assert list(own.encode_batch(sample)) == [library.encode_ordinary(t) for t in sample]


def test_ascii_pattern():
    assert bpe.ascii_pattern(r" ?\p{L}+|[^\s\p{N}]") == " ?[A-Za-z]+|[^\\s0-9]"
    assert bpe.ascii_pattern(r"\p{Lu}") is None


def test_documents(spark):
    rows = [(1, "Hello wörld", "x"), (2, None, "y"), (2, None, "y"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    outputs = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")
    found = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, outputs, keep=("doc_id", "n_tokens"))
    assert found.columns == ["doc_id", *outputs]
    got = sorted(found.collect(), key=lambda r: str(r["doc_id"]))
    assert [r["doc_id"] for r in got] == [1, 2, 2, None]
    assert bytes(got[0]["decoded"]).decode() == "Hello wörld"
    assert got[0]["ids_sha256"] == hashlib.sha256(" ".join(map(str, got[0]["ids"])).encode()).hexdigest()
    assert got[1]["n_tokens"] == got[3]["n_tokens"] == 0
    assert got[1]["ids_sha256"] == got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
