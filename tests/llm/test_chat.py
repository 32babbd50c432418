import hashlib

from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, perspective int"


def named(role):
    return "|unknown" if role is None else role.replace("\\", "\\\\").replace("|", "\\p").replace("\n", "\\n").replace("\r", "\\r")


def brute(rows):
    """(conv, perspective, turns, text, mask) of every whole dialogue."""
    out = []
    for conv in {r[0] for r in rows}:
        own = [(t, named(r), (x or "").replace("<|", "< |")) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda o: (o[0] is not None, o[0] or 0, hashlib.md5(f"{o[1]}|{o[2]}".encode()).hexdigest()[:8], o[1], o[2]))
        for me in {r for _, r, _ in own if r != "system"}:
            text, spans = "", []
            for _, r, x in own:
                head = "<|system|>\n" if r == "system" else chat.ASSISTANT if r == me else f"<|user name={r}|>\n"
                if r == me:
                    spans.append(f"{len(text) + len(head)}:{len(text) + len(head) + len(x) + len(chat.END)}")
                text = text + head + x + chat.END
            out.append((conv, me, len(own), text, ",".join(spans)))
    return sorted(out, key=str)


def talk():
    rows = [(c, t, ["ann", "bob", "cy", "system", None][(c * t) % 5], f"é{t} says <|end|> {'x' * t}") for c in range(1, 9) for t in range(c * 11)]
    rows += [(50, 0, "system", "alone"), (51, None, "ann", "a"), (51, None, "bob", None), (51, 3, "ann", ""), (52, 1, "ann", "twice"), (52, 1, "ann", "twice"), (None, 2, "bob", "lost")]
    return rows + [(53, 0, "a<|b", "q"), (53, 0, "a|>\nb", "q"), (53, 0, "unknown", "q"), (53, 1, None, "q")] + [(54, t % 40, f"s{t % 2}", "again") for t in range(400)]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "p", 1) for r in talk()], SCHEMA).repartition(3)
    shown = chat.perspectives(docs)
    assert all(r.part in (0, None) and r.piece == 0 for r in shown.collect())
    got = sorted(map(tuple, chat.joined(shown).collect()), key=str)
    assert got == brute(talk())
    whole = [tuple(r)[:2] + tuple(r)[4:] for r in shown.collect() if r.conv_id != 51]
    assert sorted(whole, key=str) == [r for r in got if r[0] != 51]
    for _, me, _, text, mask in got:
        for span in filter(None, mask.split(",")):
            a, b = map(int, span.split(":"))
            assert text[:a].endswith("<|assistant|>\n") and text[a:b].endswith(chat.END)


def test_dealt_dialogues_join_to_the_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 16)
    monkeypatch.setattr(chat, "PIECE_ROWS", 4)
    docs = spark.createDataFrame([(*r, "p", 1) for r in talk()], SCHEMA).repartition(3)
    shown = chat.perspectives(docs)
    assert sorted(map(tuple, chat.joined(shown).collect()), key=str) == brute(talk())
    assert max(r.n_turns for r in shown.collect()) <= 8


def test_repeated_turns_are_split(spark):
    docs = spark.range(5000).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("ann").alias("role"), F.lit("same").alias("text"))
    got = chat.perspectives(docs).collect()
    assert sum(r.n_turns for r in got) == 5000 and max(r.n_turns for r in got) <= chat.PIECE_ROWS


def test_empty(spark):
    assert chat.perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
