import hashlib
import re

import pytest

from tidemark.llm import mixing


def text_key(text):
    return None if text is None else int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def uniform(doc_id, text, k):
    name = ":".join("null" if x is None else str(x) for x in (doc_id, text_key(text), k))
    return (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def due(words, target, most=3.0):
    """Copies of each class: raise the level until the words reach the target, full classes stay full."""
    full, classes = set(), sorted(words, reverse=True)
    while True:
        free = [c for c in classes if c not in full]
        slope = sum(words[c] * c for c in free)
        level = (target - most * sum(words[c] for c in full)) / slope if slope else float("inf")
        over = [c for c in free if level * c > most + 1e-12]
        if not over:
            return {c: most if c in full else level * c for c in classes}
        full.add(over[0])


def brute(rows):
    """Target by source with the excess shared again and again; copies by a plain walk of the order."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    capped, left = {}, sum(total.values())
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            capped[s] = 3 * total[s]
            left -= capped[s]
    target = {s: capped.get(s, level * weight[s]) for s in names}
    out = []
    for s in names:
        seen, own, words = {}, [], {}
        for d, t, x in rows:
            if x == s:
                k = seen[d, t] = seen.get((d, t), -1) + 1
                own.append((d, t, size(t), len(f"{size(t):b}"), k))
                words[own[-1][3]] = words.get(own[-1][3], 0) + size(t)
        copies = due(words, target[s]) if total[s] else dict.fromkeys(words, 0.0)
        share = {c: x - int(x) for c, x in copies.items()}
        rest, extra = target[s] - sum(int(copies[c]) * w for c, w in words.items()), set()
        odds = lambda r: (u := uniform(r[0], r[1], r[4])) / (1 - u) / (share[r[3]] / (1 - share[r[3]]))
        order = sorted((r for r in own if share[r[3]] > 1e-12), key=odds)
        done = 0
        while order and done + order[0][2] <= rest + 1e-9:
            done += order[0][2]
            extra.add(order.pop(0))
        gap = min(order, key=lambda r: abs(r[2] - (rest - done)), default=None)
        if gap and abs(gap[2] - (rest - done)) < rest - done:
            extra.add(gap)
        out += [(r[0], r[2], total[s], round(target[s], 6), r[2] * (int(copies[r[3]]) + (r in extra))) for r in own]
    return sorted(out, key=str)


def corpus(n=400):
    return [(i, "w " * (i * 7919 % 53 + (900 if i % 97 == 0 else 0)), None if i % 11 == 0 else ["é", "b", "B", "src10", "src9", "z"][0 if i % 3 == 0 else i % 6]) for i in range(n)]


@pytest.mark.parametrize("rows", [corpus(), corpus(30), [(1, None, "a"), (2, "", None)], [(None, "a b", "s"), (7, "a b c d", "t")], corpus(40) + corpus(200) * 2 + [(7, "x y z", "b")] * 90])
def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    docs = docs.repartition(3)
    got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.taken(docs).collect()), key=str)
    assert got == brute(rows)


def test_words_come_near_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame(corpus(3000), "doc_id long, text string, source string").repartition(3)
    got, source = mixing.taken(docs).collect(), {r[0]: r[2] for r in corpus(3000)}
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size
        by.setdefault(source[r.doc_id], [r.target, 0])[1] += r.taken
    assert all(abs(t - w) <= 0.02 * t + 3 for t, w in by.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs.repartition(5)).collect()), key=str)


def test_mixed_rows_repeat_whole_documents(spark):
    docs = spark.createDataFrame([(*r, 5) for r in corpus(300)], "doc_id long, text string, source string, copies int")
    copies: dict[int, int] = {}
    for r in mixing.mix(docs).collect():
        assert r.copies == 5
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert all(copies.get(r.doc_id, 0) * r.size == r.taken for r in mixing.taken(docs).collect())


def test_an_id_that_repeats_is_drawn_row_by_row(spark):
    rows = [(7, f"w{i % 5} " * 10, "a") for i in range(600)] + [(i + 10, "v " * 10, "b") for i in range(300)] + [(i + 1000, "v " * 20, "c") for i in range(200)]
    got = mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    target = {r.target for r in got if r.doc_id == 7}.pop()
    assert len(got) == len(rows) and abs(sum(r.taken for r in got if r.doc_id == 7) - target) <= 10


def test_mix_tells_equal_rows_apart(spark):
    rows = [(7, "w w w", "a", i) for i in range(50)] + [(i + 10, "v " * 3, "b", i) for i in range(90)] + [(None, None, None, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int").repartition(3)
    took = sum(r.taken for r in mixing.taken(docs).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and sum(len((r.text or "").split()) for r in mixed.collect()) == took


def test_repeated_and_empty(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.taken(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, "a b", "s")] * 5, schema)
    assert sorted(r.taken for r in mixing.taken(same).collect()) == [2] * 5
