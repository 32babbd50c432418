"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is a node, good or bad. Its potential comes from shape
features of the line and of both neighbours, the edges tie neighbouring labels.
Forward-backward gives each line's marginal probability of being good; the mean
of the marginals, weighted by line length, is the document's quality. The field
is fitted on a bounded sample of labelled documents. Labels are known for
whole documents only, so every line carries its document's: the edges learn how
strongly neighbouring lines agree, not where quality changes within a text.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log1p
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

#: Labelled documents sampled for each class (expected), lines of a span that is learned from, and spans of a document, evenly spaced over the whole.
SAMPLE_DOCS, SPAN_LINES, SPANS = 1000, 64, 8
#: Steps and step size of the fit, and its penalty on squared weights.
STEPS, RATE, PENALTY = 150, 0.08, 1e-3

UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
SYMBOLS = b"#*$%&|<>@^~=+{}[]\\/_`"
STOPS = b".,;:?"
HIGH = bytes(range(128, 256))
FEATURES = 16


def line_features(line: bytes, seen: set[bytes]) -> list[float]:
    """Shape of a line that holds a word; ``seen`` are the lines before it."""
    words = line.split()
    n, k = len(line), len(words)
    share = lambda chars: (n - len(line.translate(None, chars))) / n
    body = line.rstrip()
    out = [
        log1p(n), log1p(k), min(40.0, (n - k + 1) / k), log1p(max(map(len, words))),
        share(UPPER), share(DIGITS), share(SYMBOLS), share(b"!"), share(STOPS), share(HIGH),
        len(set(words)) / k, len(set(zip(words, words[1:]))) / max(1, k - 1) if k > 1 else 1.0,
        sum(map(eq, words, words[1:])) / k, float(body in seen),
        float(body[-1:] in b".!?\""), float(line.lstrip()[:1] in UPPER),
    ]
    seen.add(body)
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each line with a word, and the lines' lengths in bytes."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    rows = np.array([line_features(x, seen) for x in lines], np.float32).reshape(-1, FEATURES)
    return rows, np.array([len(x) for x in lines], np.float64)


def spans(rows: np.ndarray) -> list[np.ndarray]:
    """The whole of a short text's rows; of a long one spans from its first line to its last."""
    n = len(rows)
    count = min(SPANS, -(-n // SPAN_LINES))
    if count <= 1:
        return [rows] if n else []
    return [rows[at : at + SPAN_LINES] for at in (round(k * (n - SPAN_LINES) / (count - 1)) for k in range(count))]


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after; zeros at the ends."""
    zero = np.zeros((1, rows.shape[1]), rows.dtype)
    return np.hstack([rows, np.vstack([zero, rows[:-1]]), np.vstack([rows[1:], zero])])


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the log-odds of good
    bias: float
    edges: np.ndarray  # [before, after], 0 bad and 1 good

    def marginals(self, rows: np.ndarray) -> list[float]:
        """Probability of good for each line, by forward-backward."""
        odds = with_neighbours((rows - self.mean) / self.scale) @ self.weights + self.bias
        (bb, bg), (gb, gg) = np.exp(self.edges).tolist()
        good = [1 / (1 + exp(-max(-30.0, min(30.0, x)))) for x in odds.tolist()]
        fore = []
        a = 0.5
        for i, g in enumerate(good):
            if i:
                up, down = a * gg + (1 - a) * bg, a * gb + (1 - a) * bb
            else:
                up = down = 1.0
            up, down = up * g, down * (1 - g)
            a = up / (up + down)
            fore.append(a)
        out = [0.0] * len(good)
        up = down = 1.0
        for i in range(len(good) - 1, -1, -1):
            p, q = fore[i] * up, (1 - fore[i]) * down
            out[i] = p / (p + q)
            g = good[i]
            u, d = g * up, (1 - g) * down
            up, down = gg * u + gb * d, bg * u + bb * d
            total = up + down
            up, down = up / total, down / total
        return out

    def score(self, text: str | None) -> float:
        rows, lengths = features(text)
        if not len(rows):
            return 0.0
        return min(1.0, float(np.dot(self.marginals(rows), lengths) / lengths.sum()))


def fit(docs: list[tuple[np.ndarray, int, float]], steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Field:
    """Maximise the conditional likelihood of the lines' labels by Adam over all chains (rows, label, weight) at once."""
    docs = [d for d in docs if len(d[0])]
    if not docs:
        return Field(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(3 * FEATURES), 0.0, np.zeros((2, 2)))
    every = np.vstack([x for x, *_ in docs]).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    n, most = len(docs), max(len(x) for x, *_ in docs)
    width = 3 * FEATURES
    x = np.zeros((n, most, width), np.float32)
    live = np.zeros((n, most), bool)
    y = np.array([label for _, label, _ in docs])
    for i, (rows, *_) in enumerate(docs):
        x[i, : len(rows)] = with_neighbours((rows - mean) / scale)
        live[i, : len(rows)] = True
    w, b, edges = np.zeros(width), 0.0, np.zeros((2, 2))
    slope, curve = np.zeros(width + 5), np.zeros(width + 5)
    gold = np.where(live, y[:, None], 0)
    pairs = live[:, 1:]
    weight = np.array([w for *_, w in docs]) / live.sum(axis=1)  # documents count alike
    for step in range(1, steps + 1):
        odds = np.where(live, x @ w.astype(np.float32) + b, 0.0)
        unary = np.stack([-odds / 2, odds / 2], axis=2)
        fore, back = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        fore[:, 0] = unary[:, 0]
        for t in range(1, most):
            move = np.logaddexp(fore[:, t - 1, :1] + edges[0], fore[:, t - 1, 1:] + edges[1])
            fore[:, t] = np.where(live[:, t, None], unary[:, t] + move, fore[:, t - 1])
        for t in range(most - 2, -1, -1):
            after = unary[:, t + 1] + back[:, t + 1]
            move = np.logaddexp(edges[:, 0] + after[:, :1], edges[:, 1] + after[:, 1:])
            back[:, t] = np.where(live[:, t + 1, None], move, 0.0)
        total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
        good = np.where(live, np.exp(fore[:, :, 1] + back[:, :, 1] - total[:, None]), 0.0)
        error = (gold - good) * live * weight[:, None]
        grad_w = np.einsum("ntf,nt->f", x, error.astype(np.float32), optimize=True) / n - penalty * w
        grad_edges = np.zeros((2, 2))
        for p in range(2):
            for q in range(2):
                joint = np.exp(fore[:, :-1, p] + edges[p, q] + unary[:, 1:, q] + back[:, 1:, q] - total[:, None])
                grad_edges[p, q] = (((gold[:, 1:] == q) * (p == q) - joint) * pairs * weight[:, None]).sum() / n
        grad = np.concatenate([grad_w, [error.sum() / n], (grad_edges - penalty * edges).ravel()])
        slope = 0.9 * slope + 0.1 * grad
        curve = 0.99 * curve + 0.01 * grad**2
        move = rate * (slope / (1 - 0.9**step)) / (np.sqrt(curve / (1 - 0.99**step)) + 1e-8)
        w, b, edges = w + move[:width], b + move[width], edges + move[width + 1 :].reshape(2, 2)
    return Field(mean, scale, w, float(b), edges)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit a field on a bounded sample of labelled documents.

    About SAMPLE_DOCS labelled ids of each class are drawn by a hash; a text of
    more than SPAN_LINES lines is learned from in up to SPANS spans of that many
    lines, spread evenly over the whole. Ids labelled twice count once, with the
    smaller label, and of rows that repeat an id the smallest text. Null ids,
    texts and labels are not learned from; without any, all texts score 0.5 or,
    if they have no word, 0.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("label__id")).agg(F.min(label_col).cast("int").alias("label__y"))
    sizes = {r["label__y"]: r["count"] for r in known.groupBy("label__y").count().collect()}
    drawn = F.pmod(F.xxhash64(F.col("label__id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("label__y") == 1, SAMPLE_DOCS / sizes.get(1, 1)).otherwise(SAMPLE_DOCS / sizes.get(0, 1))
    sample = known.where(drawn < share)  # 2 * SAMPLE_DOCS rows are expected: a bounded broadcast
    texts = docs.select(F.col(id_col).alias("text__id"), F.col(text_col).alias("text__text")).where("text__text is not null")
    texts = texts.join(F.broadcast(sample), F.col("text__id") == F.col("label__id"))
    texts = texts.groupBy("label__id", "label__y").agg(F.min("text__text").alias("text"))

    def step(t: pa.Table) -> pa.Table:
        found = [[x.tobytes() for x in spans(features(x)[0])] for x in t.column(2).to_pylist()]
        return pa.table({"id": t.column(0), "y": t.column(1), "x": pa.array(found, pa.list_(pa.binary()))})

    shaped = map_arrow(texts.select(F.col("label__id").cast("string"), "label__y", "text"), step, "id string, y int, x array<binary>").collect()
    chains = [(np.frombuffer(bytes(x), np.float32).reshape(-1, FEATURES), r.y, 1 / len(r.x)) for r in sorted(shaped, key=lambda r: r.id) for x in r.x]
    return fit(chains)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score, 0 to 1, of every whole text.

    Null and empty texts, and texts without a word, score 0. Lines without a
    word are no nodes. A text of any length is one chain, held by one task.
    Repeated rows are kept. Other columns are left out; an
    empty table gives no rows. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def step(t: pa.Table) -> pa.Table:
        return pa.table({id_col: t.column(0), "score": pa.array([field.score(x) for x in t.column(1).to_pylist()], pa.float64())})

    return map_arrow(docs.select(id_col, text_col), step, f"`{id_col}` {kind}, score double")


def line_labels(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line with a word: id_col, line (from 0, among such lines), good, its marginal.

    Null and empty texts give no rows, repeated rows theirs each. Other columns
    are left out; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def step(t: pa.Table) -> pa.Table:
        ids, lines, good = [], [], []
        for i, text in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            rows, _ = features(text)
            if len(rows):
                p = field.marginals(rows)
                ids += [i] * len(p)
                lines += range(len(p))
                good += p
        return pa.table({id_col: pa.array(ids, t.column(0).type), "line": pa.array(lines, pa.int32()), "good": pa.array(good, pa.float64())})

    return map_arrow(docs.select(id_col, text_col), step, f"`{id_col}` {kind}, line int, good double")
