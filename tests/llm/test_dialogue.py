import hashlib
import itertools
import random
import re
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import dialogue

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, conv int, head string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """Least (cost, audit, lines) over all edits, by a search over every way."""
    legal = re.compile(r"(s?(ua)+)?")
    best = None
    ways = [[("D", 4, None)] + ([] if w in ("blank", "duplicate") else [(e, c + 3 * (w == "truncated"), (x, t)) for e, c, x in (("K", 0, r), ("R", 3, "user"), ("R", 3, "assistant"))]) for (r, t), w in zip(rows, wrong)]
    for pick in itertools.product(*ways):
        # at most one insertion of each role fits between two turns: a third would come back to the same state
        for gaps in itertools.product((("",), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")), repeat=len(rows) + 1):
            steps = []
            for k, gap in enumerate(gaps):
                steps += [("I", 3, (x, "")) for x in gap if x]
                steps += [pick[k]] if k < len(rows) else []
            cost = sum(s[1] for s in steps)
            if best is not None and cost > best[0]:
                continue
            if any(s[2] and not s[2][0] for s in steps) or not legal.fullmatch("".join(s[2][0][0] for s in steps if s[2])):
                continue
            found = (cost, "".join(s[0] for s in steps), [f"{s[2][0]}:{s[2][1]}" for s in steps if s[2]])
            best = found if best is None or found < best else best
    return best


def codes(rows):
    kind = {"": 0, "truncated": 1, "blank": 2, "duplicate": 2}
    return bytes(dialogue.INITIALS.get(r[:1], 3) + 4 * kind[w] for (r, _), w in zip(rows, faults(rows)))


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "s", ""]), st.sampled_from(["A.", "b", "C!", " "])), max_size=4)


@settings(max_examples=150, deadline=None)
@given(ROWS)
def test_plan_equals_search_over_all_edits(rows):
    cost, audit = dialogue.Planner().plan(codes(rows))
    want = cheapest(rows, faults(rows))
    assert (cost, audit) == want[:2]
    assert [f"{r}:{t}" for _, r, t in dialogue.rewrite(audit, [(*x, 1) for x in rows]) if r is not None] == want[2]


def plain_plan(rows):
    """Forward table of (cost, audit, lines) for each state: another way than the operator's."""
    never = (10**9, "", ())
    table = [(0, "", ()), never, never, never]

    def put(s, cost, edit, line=None):
        return (s[0] + cost, s[1] + edit, s[2] + ((line,) if line is not None else ()))

    def inserted(s):
        two = min(s[2], *[put(s[q], 3, "I", "user:") for q in (0, 1, 3)])
        return [s[0], s[1], two, min(s[3], put(two, 3, "I", "assistant:"))]

    for (role, text), wrong in zip(rows, faults(rows)):
        s, more = inserted(table), 3 * (wrong == "truncated")
        table = [put(x, 4, "D") for x in s]
        if wrong in ("blank", "duplicate"):
            continue
        for q, (to, name) in enumerate(((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))):
            table[to] = min(table[to], put(s[q], 3 + more, "R", f"{name}:{text}"))
            if role[:1] == name[0]:
                table[to] = min(table[to], put(s[q], more, "K", f"{role}:{text}"))
        if role[:1] == "s":
            table[1] = min(table[1], put(s[0], more, "K", f"{role}:{text}"))
    s = inserted(table)
    return min(s[0], s[3])


def brute(turns):
    out = []
    for conv in {t[0] for t in turns}:
        rows = []
        for c, turn, role, text in sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0)):
            role, text = (" " if x is None else x for x in (role, text))
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        pairs = [r[1:] for r in rows]
        wrong, numbers = faults(pairs), {r[0] for r in rows} - {None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, lines = plain_plan(pairs)
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def talk():
    r = random.Random(3)
    rows = [(c, t * r.choice((1, 1, 3)), r.choice(("system", "user", "assistant", "assistant", "tool")), r.choice(("Yes.", "No!", "why", f"é {t}.", " ", f"turn {t}\n.\t"))) for c in range(200) for t in range(r.randint(1, 25))]
    rows = list({x[:2]: x for x in rows}.values())  # one row a turn
    rows += [(1000, None, "user", "Who?"), (1001, None, None, None), (None, 3, "user", "Hm."), (None, 5, "assistant", None), (1002, 1, "", "Empty role."), (1003, 0, "system", "Only."), (1004, 2, "assistant", "x" * 100_000)]
    return rows + [(2000, t, ("user", "assistant")[t % 2], ("Again.", f"Say {t}.")[t % 3 == 0]) for t in range(3000)]


def test_equals_brute_force(spark):
    turns = spark.createDataFrame([(*t, 1, "h") for t in talk()], SCHEMA).repartition(7)
    got = dialogue.repaired(dialogue.damaged(turns), copies_col="copies")
    assert got.columns == ["conv_id", *dialogue.COUNTS, "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(talk())


def test_rebuilt_turns_have_the_digest(spark):
    turns = spark.createDataFrame([(*t, 1, "h") for t in talk()], SCHEMA)
    hurt = dialogue.damaged(turns)
    found = {}
    for r in sorted(dialogue.rebuilt(hurt, copies_col="copies").collect(), key=lambda r: (str(r.conv_id), r.position)):
        found.setdefault(r.conv_id, []).append(r)
    for conv, _, *_, digest in brute(talk()):
        own = found.get(conv, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own)) and [r.position for r in own] == list(range(len(own)))


def test_repeated_rows_and_turns_that_share_a_number(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yo.")] + [(1, 1, "user", "Same.")] * 500 + [(1, None, "user", "Hi.")]
    got = dialogue.repaired(spark.createDataFrame([(*t, 1, "h") for t in rows], SCHEMA)).collect()[0]
    # the turn without a number comes first, so the later "Hi." is its duplicate
    assert (got.duplicate, got.blank, got.gaps) == (500, 0, 0)
    assert got.audit.count("D") >= 500 and len(got.audit) >= len(rows)


def test_empty(spark):
    assert dialogue.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    assert dialogue.rebuilt(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql_and_brute_force(spark):
    from tidemark.llm.queries import op12_turn_repair

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    got = op12_turn_repair(spark, data)
    ours = sorted(map(tuple, got.collect()), key=str)
    assert sorted(con.execute(dialogue.SQL).fetchall(), key=str) == ours
    assert [d[0] for d in con.description] == got.columns
    assert brute(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()) == ours
