"""Every stage of the pipeline against a plain version, each on what the stage before it kept."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from tests.llm.test_mixing import brute as brute_mix
from tests.llm.test_simhash import similar_groups
from tidemark.llm import langid, secrets
from tidemark.session import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, accepted boolean"
KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
SYLLABLES = {"en": ["tha", "ing", "ou", "ndre", "er"], "de": ["sch", "keit", "ge", "über", "ung"], "es": ["ción", "ñoz", "que", "lla", "ar"]}


def corpus():
    rng = random.Random(4)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(150):
        lang = rng.choice(list(SYLLABLES))
        text = [word(lang) for _ in range(rng.choice([30, 90, 400]))]
        if i % 10 == 0:
            text.insert(5, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"')
        if i % 13 == 0:
            text.insert(9, "4111111111111111")
        copies = rng.choice([1, 1, 1, 2, 3])
        for _ in range(copies):
            rows.append((len(rows), " ".join(text), lang, rng.choice(["a", "b", "c", None]), len(" ".join(text)), True))
            text[rng.randrange(10, len(text))] = word(lang)
    odd = [(900, None, "en", "a", None, None), (901, "", None, "b", 0, False), (902, "12 34 !!", "en", "a", 8, True), (3, rows[9][1], "en", None, 1, None), rows[0], rows[0], (None, rows[5][1] + " end", "de", "a", 9, None)]
    return rows + odd


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before each stage, and the last one's rows."""
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(path)), name)
        out.append(docs)
    whole = corpus_pipeline.run(spark, str(path))
    return {"documents": spark.read.parquet(f"{path}/documents.parquet"), **dict(zip([n for n, _ in corpus_pipeline.STAGES], out)), "run": whole}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_language(stages):
    docs = stages["documents"]
    assert stages["language"].columns == docs.columns
    classify = langid.Classifier(langid.learn(docs))
    want = [(*r[:2], classify(r.text)[0], *r[3:]) for r in docs.collect() if classify(r.text)[2]]
    assert rows(stages["language"]) == sorted(want, key=str)
    assert len(want) >= len(corpus()) - 8  # clean documents stay


def test_near_duplicates(stages):
    before = stages["language"].collect()
    groups = {}
    for r, root in zip(before, similar_groups([r.text for r in before])):
        groups.setdefault(root, []).append(r)
    got = stages["near_duplicates"].collect()
    assert len(got) == len(groups) < len(before)
    for own in groups.values():
        kept = [r for r in got if r in own]
        least = min((r.doc_id is None, r.doc_id or 0) for r in own)
        assert len(kept) == 1 and (kept[0].doc_id is None, kept[0].doc_id or 0) == least


def test_secrets(stages):
    before = stages["near_duplicates"]
    flagged = [r for r in secrets.scan(before, secrets.learn(before)).collect() if r.is_secret]
    planted = {hashlib.sha1(str(i).encode()).hexdigest() for i in range(0, 150, 10)}
    assert {r.candidate for r in flagged} <= planted and len(flagged) >= 14
    want = []
    for r in before.collect():
        text = r.text
        for f in sorted((f for f in flagged if f.doc_id == r.doc_id and r.text[f.start :].startswith(f.candidate)), key=lambda f: -f.start):
            text = text[: f.start] + secrets.MASK + text[f.start + len(f.candidate) :]
        want.append((r.doc_id, text, r.lang, r.source, len(text) if text != r.text else r.n_chars, r.accepted))
    assert rows(stages["secrets"]) == sorted(want, key=str)


def test_mixing(stages):
    words, got = {}, {}
    for d, _, _, _, took in brute_mix([(r.doc_id, r.text, r.source) for r in stages["secrets"].collect()]):
        words[d] = words.get(d, 0) + took
    for r in stages["mixing"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {d: n for d, n in words.items() if n}


def test_encoding_and_run(stages):
    codec = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = [(r.doc_id, codec.encode_ordinary(r.text)) for r in stages["mixing"].collect()]
    assert sorted(((r.doc_id, r.token_ids) for r in stages["encoding"].collect()), key=str) == sorted(want, key=str)
    assert rows(stages["run"]) == rows(stages["encoding"])


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_columns_of_any_name_pass(spark):
    """Names that the operators use themselves, and names with dots and spaces."""
    names = ["row__text", "told__lang", "told__accepted", "row", "whole", "text_", "id", "fp", "lang_pred", "accepted", "my col", "a.b"]
    base = [r[:5] for r in corpus()]
    docs = spark.createDataFrame([(*r, *[f"{n}{k}" for n in names]) for k, r in enumerate(base)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (corpus_pipeline.known_language, corpus_pipeline.near_deduplicated):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        found = out.collect()
        assert len(found) > 50 and all(r[n][: len(n)] == n and r[n][len(n) :] == r["a.b"][3:] for r in found for n in names)
