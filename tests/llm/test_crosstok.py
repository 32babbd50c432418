import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import crosstok

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block int, ids string, codes int"
ODD = "a'z9.᠎​\xa0 \x1c\x85 \n\t\r　é日🎉_-=\x00"


@pytest.fixture(scope="module")
def pair():
    return crosstok.Pair(crosstok.load(FIRST), crosstok.load(SECOND))


@pytest.fixture(scope="module")
def whole():
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def ends(tokens):
    at, out = 0, []
    for x in tokens:
        at += len(x)
        out.append(at)
    return out


def brute(rows, pair, whole):
    """(doc, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) from whole texts."""
    a_of, b_of = whole
    docs, held = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
            x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
            if b"".join(x) == b"".join(y) == (" " + text).encode():
                ea, eb = ends(x), ends(y)
                i = j = 0
                for cut in sorted(set(ea) & set(eb)):
                    ga, gb = [], []
                    while i < len(a) and ea[i] <= cut:
                        ga.append(a[i])
                        i += 1
                    while j < len(b) and eb[j] <= cut:
                        gb.append(b[j])
                        j += 1
                    groups.append((ga, gb))
        docs.append((doc, groups))
        held.update({(p, q) for ga, gb in groups for p in ga for q in gb})
    best = {}
    for (p, _), n in held.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for doc, groups in docs:
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    rows = [(i, "".join(r.choice(ODD) for _ in range(r.randint(1, 60)))) for i in range(150)]
    rows += [(i, " ".join(r.choice(["the", "Straße", "naïve", "12,345", "don't", "日本語", "<|endoftext|>", "</s>", "it's", "\n\n", "\r\n"]) for _ in range(r.randint(1, 80)))) for i in range(200, 320)]
    rows += [(400, None), (401, ""), (402, " "), (403, "lost ▁ piece"), (404, "the 12,345"), (404, "the 12,345"), (None, "the end"), (405, "\n"), (406, "=" * 5000), (407, "word " * 20000), (408, "x" * 3000 + " " * 500), (409, "ﬁ Å é")]
    return rows


def test_cuts_hold_in_both_vocabularies(pair, whole):
    r = random.Random(2)
    assert " " in pair.white and "\n" in pair.white and "\r" not in pair.white
    for _ in range(4000):
        text = "".join(r.choice(ODD) for _ in range(r.randint(1, 16)))
        parts = pair.segments(" " + text)
        assert "".join(parts) == " " + text
        a, b = pair.tokenised(parts)
        assert sum(a, []) == whole[0].encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == whole[1].encode(text)


def test_without_a_safe_cut_a_text_is_one_segment():
    assert crosstok.cut_points([b"a b", b"a\n"]) == "\t\x0b\x0c\r"
    assert crosstok.cutter("")("a b") == ["a b"]
    assert crosstok.cutter(" ")("a b\n c\xa0 d") == ["a", " b\n c\xa0 d"]


def test_equals_brute_force(spark, pair, whole, monkeypatch):
    monkeypatch.setattr(crosstok, "BLOCK_CHARS", 2000)
    docs = spark.createDataFrame([(*r, 1, "i", 2) for r in corpus()], SCHEMA).repartition(4)
    got = crosstok.align(docs, FIRST, SECOND)
    assert got.columns == ["doc_id", *crosstok.NUMBERS, "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus(), pair, whole)


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "the naïve", 1, "i", 2), (2, None, 1, "i", 2)], SCHEMA)
    for r in crosstok.align(docs, FIRST, SECOND, groups=True).collect():
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256
        assert r.groups.count(";") + 1 == r.n_groups or not r.groups


def test_empty(spark):
    assert crosstok.align(spark.createDataFrame([], SCHEMA), FIRST, SECOND).count() == 0


def test_query_equals_brute_force(spark, pair, whole):
    from tidemark.llm.queries import op13_segment_alignment

    data = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = op13_segment_alignment(spark, data)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, pair, whole)
