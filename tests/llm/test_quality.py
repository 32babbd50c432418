import random
import zlib
from itertools import product

import numpy as np
import pytest

from tidemark.llm import quality
from tidemark.llm.queries import op1_crf_quality


def brute_marginals(field, rows):
    """By summing over all label sequences."""
    odds = quality.with_neighbours((rows - field.mean) / field.scale) @ field.weights + field.bias
    total, good = 0.0, np.zeros(len(rows))
    for ys in product((0, 1), repeat=len(rows)):
        p = np.exp(sum(o * y for o, y in zip(odds, ys)) + sum(field.edges[a, b] for a, b in zip(ys, ys[1:])))
        total += p
        good += p * np.array(ys)
    return good / total


def test_spans_reach_from_the_first_line_to_the_last():
    assert quality.spans(np.zeros((0, 2))) == [] and len(quality.spans(np.arange(64)[:, None])) == 1
    rows = np.arange(5000)[:, None]
    found = quality.spans(rows)
    assert len(found) == quality.SPANS and all(len(x) == quality.SPAN_LINES for x in found)
    assert found[0][0, 0] == 0 and found[-1][-1, 0] == 4999


def line(rng, good):
    words = ["".join(rng.choice(["tha", "ing", "ou", "er"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 20))]
    return " ".join(words).capitalize() + "." if good else rng.choice(["!! ".join(words).upper() + "!!", " | ".join(words), "$$$ ".join(words)])


def corpus(n=400):
    rng = random.Random(8)
    return [(i, "\n".join(line(rng, i % 3 > 0) for _ in range(rng.choice([1, 4, 30]))), int(i % 3 > 0)) for i in range(n)]


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(1)
    field = quality.Field(np.zeros(16), np.ones(16), rng.normal(size=48) / 5, 0.3, np.array([[1.0, -0.5], [0.2, 0.7]]))
    for n in (1, 2, 6, 10):
        rows = rng.normal(size=(n, 16)).astype(np.float32)
        assert field.marginals(rows) == pytest.approx(list(brute_marginals(field, rows)))


def test_held_out_ranking(spark, tmp_path):
    rows = corpus()
    extra = [(900, None), (901, ""), (902, "\n \n"), (0, rows[0][1]), (None, rows[1][1]), (903, "word " * 100_000)]
    docs = [(i, t, "en", 0.5) for i, t, _ in rows] + [(*r, None, 0.5) for r in extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, y, 0) for i, _, y in rows] + [(0, 1, 0), (None, 1, 0), (5, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op1_crf_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id in (900, 901, 902):
            assert r.score == 0.0
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_bad_block_inside_a_good_document(spark):
    rng = random.Random(3)
    field = quality.fit([(x, y, 1.0) for _, t, y in corpus() for x in quality.spans(quality.features(t)[0])])
    text = "\n".join([line(rng, True) for _ in range(12)] + [line(rng, False) for _ in range(12)])
    p = [r.good for r in quality.line_labels(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).orderBy("line").collect()]
    assert len(p) == 24 and np.mean(p[:10]) > 0.7 > 0.3 > np.mean(p[-10:])
    assert field.score(text) == pytest.approx(np.average(p, weights=[len(x) for x in text.split("\n")]))


def test_nothing_labelled_or_nothing_to_score(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    field = quality.learn(docs, labels)
    assert quality.score(docs, field).count() == 0 and field.score("a line") == pytest.approx(0.5)
