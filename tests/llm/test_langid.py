import random
import zlib

import pytest

from tidemark.llm import langid
from tidemark.llm.queries import op7_zstd_language

SYLLABLES = {"aa": ["tha", "ing", "ou", "ndre"], "bb": ["sch", "über", "keit", "ge"], "cc": ["ción", "ñoz", "que", "lla"]}


def text(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=300):
    rng = random.Random(2)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(n)]
    return [(i, text(x, rng.choice([4, 30, 3000 if i % 50 == 0 else 90]), rng), x) for i, x in enumerate(langs)]


@pytest.fixture(scope="module")
def table_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("langs")
    rows = [(*r, "s", 1.5) for r in corpus()] + [(900, None, "aa", "s", 0.0), (901, "", None, None, 0.0), (902, "12 !! 34", "bb", "s", 0.0), (None, "keitgeüber schkeit übergegekeit", "bb", "s", 0.0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_held_out_accuracy(spark, table_dir):
    truth = {r[0]: r[2] for r in corpus()}
    got = op7_zstd_language(spark, table_dir).collect()
    assert len(got) == 304
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        if r.doc_id is None:
            assert r.lang_pred == "bb"
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_choice_is_the_smallest_of_whole_texts(spark, table_dir):
    docs = spark.read.parquet(f"{table_dir}/documents.parquet")
    classify = langid.Classifier(langid.learn(docs))
    long = text("aa", 500, random.Random(1)) + text("bb", 4000, random.Random(1))
    assert classify(long)[0] == "bb"  # most of the text lies past any prefix
    assert classify("xyz")[2] is False or classify("xyz")[1] > 0


def test_every_language_is_learned_from_whole_texts(spark):
    rows = [(i, "common header of all texts " * 40 + f"{chr(945 + i)}{chr(960 + i)} " * 2000, f"l{i:03}") for i in range(120)]
    found = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(found) == 120
    classify = langid.Classifier({k: found[k] for k in ("l000", "l005", "l020")})
    assert classify(f"{chr(950)}{chr(965)} " * 30)[0] == "l005"


def test_carried_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "abc def", 5, "x")], "doc_id long, text string, accepted int, score string")
    told = langid.identify(docs, {"aa": b"abc def"}, keep=docs.columns, names=("l", "s", "a"))
    assert told.columns == ["doc_id", "text", "accepted", "score", "l", "s", "a"] and told.first().accepted == 5
    assert langid.identify(docs, {"aa": b"abc def"}, keep=docs.columns).columns == ["doc_id", "text", "lang_pred", "score", "accepted"]


def test_nothing_to_learn_or_label(spark):
    docs = spark.createDataFrame([(1, "abc", None), (1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.learn(docs) == {}
    assert [r.lang_pred for r in langid.identify(docs, {}).collect()] == ["und", "und"]
    assert langid.identify(docs.limit(0), {"aa": b"abc def"}).count() == 0
    assert langid.identify(docs, {"aa": b"abc def"}, keep=["lang", "doc_id"]).columns == ["lang", "doc_id", "lang_pred", "score", "accepted"]
