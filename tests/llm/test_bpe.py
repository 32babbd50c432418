import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(codec, library):
    rng = random.Random(7)
    alphabets = ["ab", "aaaa ", " \n\t", "é漢字🙂", "abcdefghij", "0123", "!?<|endoftext|>", "thingationer"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60)))
        ids = codec.encode_bytes(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_runs_equal_the_library(codec, library):
    text = "a" * 20_000 + "ab" * 10_000 + "é" * 5_000
    assert np.frombuffer(codec.encode_bytes(text), "<u4").tolist() == library.encode_ordinary(text)


def test_walk_equals_plain_merging(codec):
    rng = random.Random(3)
    for _ in range(500):
        data = "".join(rng.choice("thaneriou") for _ in range(rng.randint(1, 24))).encode()
        assert codec.encode_piece(data) == bpe.merge_by_rank(data, codec.ranks)


def test_operator_edge_cases(spark, library):
    rows = [(1, "That it.", 5), (1, "That it.", 5), (2, None, 6), (3, "", 7), (None, "a b", 8), (4, "né " * 3000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN, ids=True).collect()
    assert sorted((r.doc_id or -1) for r in got) == [-1, 1, 1, 2, 3, 4]
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
