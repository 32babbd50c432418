import hashlib
import random

from pyspark.sql import functions as F

from tidemark.llm import lines

SCHEMA = "doc_id long, text string, id string, lines int, gone string"
WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_docs=2, min_chars=10):
    held = {}
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(doc)
    first = {k: min(d for d in docs if d is not None) for k, docs in held.items() if len(docs) >= min_docs}
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if first.get(key(x), doc) == doc]
        out.append((doc, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus():
    r = random.Random(7)
    pool = ["a line that all share", "A LINE that all Share\t", "\x0bÉclair à la crème", "éclair à la crème", "short", "ninechars", "tencharsss", "日本語の長い行です。はい", "", "\xa0wide space kept\xa0", "wide space kept"]
    rows = [(d, "\n".join(r.choice(pool) if r.random() < 0.5 else f"own line {d} {r.random()}" for _ in range(r.randint(1, 30)))) for d in range(60)]
    rows += [(5, "a line that all share\nelse"), (5, "a line that all share\nelse"), (None, "nobody has this line\nnobody has this line"), (None, "a line that all share"), (-1, "tencharsss\ntencharsss")]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a line that all share"), (None, "nobody has this line"), (104, "\n".join(f"long {i % 900} line of many" for i in range(20000))), (105, "long 7 line of many\n\n")]
    return rows


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in corpus()], SCHEMA).repartition(5)
    for min_docs in (2, 4):
        got = lines.deduplicate_lines(docs, min_docs=min_docs)
        assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(corpus(), min_docs)


def test_documents_equal_brute_force_and_sql(spark):
    import duckdb

    from tidemark.llm.queries import op11_line_dedup

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute([(r.doc_id, r.text) for r in docs.collect()])]
    got = op11_line_dedup(spark, data).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(con.execute(lines.SQL).fetchall(), key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 0


def test_empty_and_names(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lines.deduplicate_lines(none).count() == 0
    named = spark.createDataFrame([("b", "one shared line"), ("a", "one shared line")], "`my id` string, `the text` string")
    got = lines.deduplicate_lines(named, id_col="my id", text_col="the text").select(F.col("my id"), "n_dropped").collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("b", 1)]
