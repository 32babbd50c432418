import random

import numpy as np
import xxhash

import corpus_pipeline
from tidemark.llm import components as stars
from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_print(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def brute(rows, radius):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("thaneriouXÉ") for _ in range(rng.randint(1, 7)))
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.choice([1, 2, 3, 9, 60, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = word()
    return [*rows, (500, None), (501, ""), (502, " \n\t"), (3, rows[3][1]), (None, rows[4][1]), (None, "alone at last")]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, fp long").repartition(5)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    want = brute(rows, 2)
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = simhash.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(c for c in dict.fromkeys((c for _, _, c in want)) if c is not None)
    assert [r.text for r in kept if r.doc_id is None] == ["alone at last"]


def test_forest_joins_what_all_close_pairs_join():
    bits = [0] + [1 << k for k in range(64)] + [1 << k | 1 << m for k in range(64) for m in range(k)]
    a = np.array(bits, np.uint64)
    links = simhash.forest(a, a, 2, same=True)
    assert len(links) == len(bits) - 1
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 12, n).astype(np.uint64) | np.uint64(k << 40) for n, k in ((90, 1), (70, 2)))
    for radius in (2, 4, 6):
        groups = []
        for pairs in ([(i, j) for _, i, j in simhash.forest(a, b, 6) if (int(a[i]) ^ int(b[j])).bit_count() <= radius], [(i, j) for i in range(90) for j in range(70) if (int(a[i]) ^ int(b[j])).bit_count() <= radius]):
            root = list(range(160))
            for i, j in pairs:
                x, y = root[i], root[90 + j]
                root = [y if r == x else r for r in root]
            groups.append({frozenset(k for k in range(160) if root[k] == r) for r in root})
        assert groups[0] == groups[1]


def test_similar_texts_of_five_words(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("thaneriou") for _ in range(rng.randint(2, 7)))
    rows, near = [], 0
    for i in range(150):
        text = [word() for _ in range(rng.choice([40, 120, 400]))]
        rows.append((2 * i, " ".join(text)))
        if i % 3 == 0:
            text[rng.randrange(len(text))] = word()
            near += simhash.resemblance(rows[-1][1], " ".join(text), 5) >= 0.8
            rows.append((2 * i + 1, " ".join(text)))
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper())]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = {r.doc_id for r in simhash.deduplicate(docs, radius=12, words=5, similarity=0.8).collect()}
    assert {2 * i for i in range(150)} <= kept and not kept & {1000, 1001}
    assert len(rows) - 2 - len(kept) >= 0.9 * near


def families(seed, n):
    """Texts in families of copies, each with some words of the first or of another copy changed."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("thaneriou") for _ in range(rng.randint(2, 7)))
    texts = []
    for _ in range(n):
        family = [[word() for _ in range(rng.choice([80, 150, 400]))]]
        for _ in range(7):
            copy = list(rng.choice(family))
            for at in rng.sample(range(len(copy)), round(len(copy) * rng.uniform(0.015, 0.03))):
                copy[at] = word()
            family.append(copy)
        texts += [" ".join(x) for x in family]
    return texts


def similar_groups(texts):
    """The smallest position each text reaches by pairs of a similarity of 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def test_verified_links_lose_none_to_the_forest(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 3)
    texts = families(3, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(docs, radius=32, words=5, similarity=0.8).collect()
    assert [r.component_id for r in sorted(got)] == similar_groups(texts)


def test_runs_of_parts_lose_no_link(spark, monkeypatch):
    for name, value in (("PART", 2), ("TILE", 3), ("RUN", 2)):
        monkeypatch.setattr(simhash, name, value)
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2)
    texts = families(6, 25)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.near_duplicates(docs, radius=32, words=5, similarity=0.8).collect()
    assert [r.component_id for r in sorted(got)] == similar_groups(texts)


def test_pipeline_stage_finds_every_similar_pair(spark):
    texts = families(8, 60)
    words = [w for t in texts[:40] for w in t.split()]
    rng = random.Random(2)
    for n in [6, 8, 9, 12, 13, 20] * 20:  # a word more or less at an end, a part said twice
        at = rng.randrange(len(words) - 40)
        texts += [" ".join(words[at : at + n]), " ".join(words[at : at + n + 1]), " ".join(words[at : at + n] + words[at : at + 4])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_deduplicated(spark, docs, "").collect())
    assert kept == sorted(set(similar_groups(texts)))


def test_rows_without_id_are_verified_too(spark):
    text = families(4, 1)[0]
    other = text + " more"
    docs = spark.createDataFrame([(None, text), (None, other), (1, "x " + text)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicate(docs, radius=76, words=5, similarity=0.8, seeds=4).collect()] == [1]


def test_a_repeated_id_loses_no_other_text(spark):
    one, two, three = families(4, 3)[::8]
    docs = spark.createDataFrame([(1, one, "a"), (1, two, "b"), (2, three, None), (2, three, None), (None, three, "c"), (None, two + " end", None)], "doc_id long, text string, note string")
    got = simhash.deduplicate(docs, radius=76, words=5, similarity=0.8, seeds=4)
    assert got.columns == docs.columns
    assert sorted(got.collect(), key=str) == sorted([(1, one, "a"), (1, two, "b"), (2, three, None)], key=str)


def test_components_of_a_hub(spark):
    rng = random.Random(1)
    links = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(2990, 4000)] + [(9000 + i, 9001 + i) for i in range(0, 40, 2)]
    rng.shuffle(links)
    got = {r.u: r.root for r in components(spark.createDataFrame(links, "u long, v long").repartition(4)).collect()}
    assert len(got) == 3000 + 1000 + 1 + 40 and all(r == 0 for u, r in got.items() if u < 9000)
    assert all(got[9000 + i] == got[9001 + i] == 9000 + i for i in range(0, 40, 2))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "u long, v long")
    assert {(r.u, r.root) for r in components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    """Each names the written links a few times: large plans fill the driver's memory."""
    scans, write = [], stars.cut

    def counted(df, name):
        scans.append(len([x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x]))
        return write(df, name)

    monkeypatch.setattr(stars, "cut", counted)
    links = spark.createDataFrame([(0, i) for i in range(1, 50)] + [(i + 1, i) for i in range(60, 70)], "u long, v long")
    assert {(r.u, r.root) for r in components(links).collect()} == {(i, 0) for i in range(50)} | {(i, 60) for i in range(60, 71)}
    assert len(scans) > 2 and max(scans) <= 8


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.deduplicate(docs).count() == 0


def test_long_text():
    text = "word " * 120_000
    assert simhash.fingerprint(text) == brute_print(text)
