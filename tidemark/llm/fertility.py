"""Quality rules on tokeniser fertility.

Two public vocabularies measure every whole text: a byte-level one gives the
characters per token and the entropy of the tokens, one with byte fallback the
share of tokens that are bare bytes. Each language, or script where no language
is known, has rejection bands for the measures, so that an alphabet the
vocabularies know badly is judged among its own. As the measures drift with
length, each is fitted against the logarithm of the number of tokens over all
texts, its spread too, and the bands are fences on the residuals. Texts also
carry base counts of words, symbols, repeated lines and repeated word windows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import load_ranks
from tidemark.llm.common import map_arrow, per_task
from tidemark.session import cut

SYMBOLS = "#*$%&|<>"
WHITE = b" \t\n\v\f\r"
#: Scripts with bands of their own; a text belongs to the one with most of its letters.
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai"]
#: Texts of fewer tokens are left out of the fits. Their verdict does not depend on it: a text of 50 words has 50 tokens, with fewer words it fails the base rules.
MIN_TOKENS = 50
#: Fences in spreads below and above the fitted line. High entropy for the length is what rich texts have, low fallback what plain ones have.
FENCES = {"chars_per_token": (3.5, 6.0), "fallback_share": (None, 6.0), "entropy": (3.5, None)}
#: Junk is low in both of these at once: a fence on their sum, in spreads of that sum.
BOTH, BOTH_FENCE = ("chars_per_token", "entropy"), 2.75
#: Times the line is fitted, and the spreads beyond which a text is left out of the next fit.
FITS, TRIM = 3, 3.0
#: Least spreads, as a corpus of one mould must not reject its next text, and the spreads that count as PRIOR texts more where texts are few.
LEAST_SPREAD = {"chars_per_token": 0.01, "fallback_share": 0.002, "entropy": 0.005}
PRIOR_SPREAD, PRIOR = {"chars_per_token": 0.1, "fallback_share": 0.002, "entropy": 0.04}, 20
#: Bins of a measure, equally wide from 0 to TOPS, whose counts give the first quartiles.
BINS, TOPS = 8192, {"chars_per_token": 16.0, "fallback_share": 1.0, "entropy": 1.0}

LETTERS = regex.compile("|".join(rf"(\p{{{s}}}+)" for s in SCRIPTS))
LATIN = regex.compile(r"\p{Latin}")
OTHERS = regex.compile("[" + "".join(rf"\p{{{s}}}" for s in SCRIPTS[1:]) + "]")


def script_of(text: str) -> str:
    """The script with most letters; ``Other`` if no known one has any. Ties: the first listed."""
    if not OTHERS.search(text):
        return "Latin" if LATIN.search(text) else "Other"
    counts = dict.fromkeys(SCRIPTS, 0)
    for m in LETTERS.finditer(text):
        counts[SCRIPTS[m.lastindex - 1]] += m.end() - m.start()
    return max(SCRIPTS, key=counts.get)


def base_counts(text: str) -> dict[str, int]:
    """Words, their code points, symbols, repeated lines and words in repeated windows of three."""
    words = text.encode().split()
    n_white = sum(map(text.count, (" ", "\t", "\n", "\v", "\f", "\r")))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return {
        "n_words": len(words),
        "word_chars": len(text) - n_white,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    at = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    n = len(seen)
    pairs = at[:-1] * n + at[1:]
    if n < 2_000_000:
        windows = pairs[:-1] * n + at[2:]
    else:  # codes of three words would not fit 63 bits
        windows = np.unique(pairs, return_inverse=True)[1][:-1] * n + at[2:]
    _, code, times = np.unique(windows, return_inverse=True, return_counts=True)
    hit = times[code] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


class Meter:
    """Measures texts with both vocabularies."""

    def __init__(self, rank_file: bytes, pattern: str, piece_model: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
        self.bytes_level = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        white = {self.pieces.piece_to_id(f"<0x{b:02X}>") for b in WHITE}  # the vocabulary has no line break: that is no fallback
        self.bare = np.array([self.pieces.is_byte(i) and i not in white for i in range(self.pieces.get_piece_size())])

    def __call__(self, text: str) -> dict:
        ids = np.array(self.bytes_level.encode_ordinary(text), np.int64)
        pieces = np.array(self.pieces.encode(text, num_threads=1), np.int64)
        n = len(ids)
        p = np.bincount(ids)[np.unique(ids)] / n if n else np.array([])
        return {
            "script": script_of(text),
            "n_tokens": n,
            "chars_per_token": len(text) / n if n else 0.0,
            "fallback_share": float(self.bare[pieces].mean()) if len(pieces) else 0.0,
            # of the tokens used, over the most that so many tokens can have: 0 to 1
            "entropy": float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 0.0,
        }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["chars_per_token", "fallback_share", "entropy"]


def measure(docs: DataFrame, rank_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """id_col, the base counts, script, n_tokens, the three measures and the family of every whole text."""
    rank_file, piece_model = load_ranks(rank_path), load_ranks(piece_path)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        meter = Meter(rank_file, pattern, piece_model)

        def step(t: pa.Table) -> pa.Table:
            texts = [x or "" for x in t.column(1).to_pylist()]
            rows = [base_counts(x) | meter(x) for x in texts]
            columns = {id_col: t.column(0)}
            for c in [*COUNTS, "n_tokens"]:
                columns[c] = pa.array([r[c] for r in rows], pa.int64())
            columns["script"] = pa.array([r["script"] for r in rows], pa.string())
            langs = t.column(2).to_pylist()
            columns["family"] = pa.array([a or r["script"] for a, r in zip(langs, rows)], pa.string())
            for c in MEASURES:
                columns[c] = pa.array([r[c] for r in rows], pa.float64())
            return pa.table(columns)

        return step

    schema = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in [*COUNTS, 'n_tokens'])}, script string, family string, {', '.join(f'{c} double' for c in MEASURES)}"
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None)
    return map_arrow(docs.select(id_col, text_col, lang.cast("string").alias("known__lang")), per_task(make), schema)


def spreads_off(c: str) -> Column:
    """How many spreads a measure lies off the line of its family."""
    width = F.greatest(F.col(f"{c}_wide") + F.col(f"{c}_wider") * F.col("x"), F.lit(LEAST_SPREAD[c]))
    width = (F.col(f"{c}_texts") * width + PRIOR * PRIOR_SPREAD[c]) / (F.col(f"{c}_texts") + PRIOR)
    return (F.col(c) - F.col(f"{c}_at") - F.col(f"{c}_slope") * F.col("x")) / width


def line(y: Column, x: Column, at: str, slope: str, scale: float = 1.0) -> list[Column]:
    """Offset and slope of the least-squares line, flat where lengths do not differ; rounded, so that the order of sums does not count."""
    flat = F.regr_slope(y, x).isNull()
    return [
        F.round(scale * F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x)), 10).alias(at),
        F.round(scale * F.coalesce(F.regr_slope(y, x), F.lit(0.0)), 10).alias(slope),
    ]


def quartiles(judged: DataFrame) -> DataFrame:
    """Texts and quartiles of each measure by family, to the width of a bin: counts of bins, the same in any order of rows."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.least(F.lit(BINS - 1), F.floor(F.col(c) * F.lit(BINS / TOPS[c]))).cast("int").alias("bin")) for c in MEASURES])).alias("x")
    counts = judged.select("family", each).select("family", "x.*").groupBy("family", "measure", "bin").count()
    # a family and measure has at most BINS rows here
    upto = F.sum("count").over(Window.partitionBy("family", "measure").orderBy("bin"))
    texts = F.sum("count").over(Window.partitionBy("family", "measure"))
    placed = counts.select("family", "measure", "bin", upto.alias("upto"), texts.alias("texts"))
    at = lambda c, q: F.min(F.when((F.col("measure") == c) & (F.col("upto") >= q * F.col("texts")), (F.col("bin") + 0.5) * F.lit(TOPS[c] / BINS)))
    return placed.groupBy("family").agg(
        *[x for c in MEASURES for x in (F.max(F.when(F.col("measure") == c, F.col("texts"))).alias(f"{c}_texts"), at(c, 0.25).alias(f"{c}_low"), at(c, 0.5).alias(f"{c}_mid"), at(c, 0.75).alias(f"{c}_high"))]
    )


def bands(measured: DataFrame) -> DataFrame:
    """Line and spread of each measure against x, the logarithm of the tokens, by family.

    One rule at every size: a fit over all texts, repeated without those far
    off the last one. The first leaves out what is far off the median, as a few
    odd texts of odd lengths would draw the line to themselves.
    """
    judged = measured.where(F.col("n_tokens") >= MIN_TOKENS).select("family", F.log2("n_tokens").alias("x"), *MEASURES)
    flat = [x for c in MEASURES for x in (F.col(f"{c}_mid").alias(f"{c}_at"), ((F.col(f"{c}_high") - F.col(f"{c}_low")) / 1.349).alias(f"{c}_wide"), F.lit(0.0).alias(f"{c}_slope"), F.lit(0.0).alias(f"{c}_wider"))]
    fits = cut(quartiles(judged).select("family", *[f"{c}_texts" for c in MEASURES], *flat), "fertility-fits")
    for _ in range(FITS):
        rows = judged.join(fits, "family").select("family", "x", *[F.when(F.abs(spreads_off(c)) <= TRIM, F.col(c)).alias(c) for c in MEASURES])
        lines = rows.groupBy("family").agg(*[x for c in MEASURES for x in [*line(F.col(c), F.col("x"), f"{c}_at", f"{c}_slope"), F.count(c).alias(f"{c}_texts")]])
        lines = cut(lines, "fertility-lines")
        off = {c: F.col(c) - F.col(f"{c}_at") - F.col(f"{c}_slope") * F.col("x") for c in MEASURES}
        # the mean distance of normal scatter, times 1.2533, is its spread
        wide = [x for c in MEASURES for x in line(F.abs(off[c]), F.col("x"), f"{c}_wide", f"{c}_wider", 1.2533)]
        # measures that move together have a wider sum
        together = F.corr(*[off[c] for c in BOTH])
        together = F.when(F.isnan(together), 0.0).otherwise(F.greatest(F.coalesce(together, F.lit(0.0)), F.lit(0.0)))
        fits = cut(lines.join(rows.join(lines, "family").groupBy("family").agg(*wide, F.round(together, 10).alias("together")), "family"), "fertility-fits")
    return fits


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rank_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Base counts, measures and verdict of every whole text.

    Returns id_col, the five base counts, base_failed, kept, and then script,
    n_tokens and the measures. Null texts count as empty: no words, so the base
    rules fail them and they are not kept. Texts of any length are encoded
    whole. Without a language, or without that column, a text's
    script is its group. Repeated rows are kept each. Other columns are left
    out; an empty table gives no rows. The bands are counted over all texts.
    """
    measured = cut(measure(docs, rank_path, pattern, piece_path, id_col, text_col, lang_col), "fertility")
    inside = sum(spreads_off(c) for c in BOTH) >= -BOTH_FENCE * F.sqrt(2 * (1 + F.col("together")))
    for c, (low, high) in FENCES.items():
        inside = inside & (spreads_off(c) >= -low if low else F.lit(True)) & (spreads_off(c) <= high if high else F.lit(True))
    passed = F.coalesce(inside, F.lit(True))
    return (
        measured.withColumn("x", F.log2("n_tokens")).join(bands(measured), "family", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & passed)
        .select(id_col, *COUNTS, "base_failed", "kept", "script", "n_tokens", *MEASURES)
    )
