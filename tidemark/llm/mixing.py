"""Mixing sources to target weights by Pareto order sampling.

Within a source documents are due unequal numbers of copies: in proportion to
the binary digits of their number of words, so that longer ones are likelier,
up to ``most``, at the level where a source's words reach its target. The whole
part is taken for certain; the rest is the inclusion probability of one more
copy. Documents are ranked by random odds divided by these inclusion odds, and
the longest prefix of that order whose words fit what is left of the target
gets the extra copy: a sample of fixed size, in words, with unequal
probabilities. One more document of each source, the one whose size comes
nearest to the words still missing, closes the gap that a long document at the
end of the prefix would leave. Random numbers are hashes of id, text and, for
rows equal in both, a counter, so reruns agree and rows that repeat an id are
drawn one by one. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, word_count
from tidemark.session import cut

#: Cells of the sampling order; only the cell that holds the cut is sorted.
CELLS = 4096
#: Sources up to which their statistics are broadcast; beyond, they are joined.
BROADCAST_SOURCES = 50_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _text_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5; null for null."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _uniform() -> Column:
    """In (0, 1), from the first 52 bits of an MD5 of id, text key and counter."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("id", "text", "k")])
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _digits() -> Column:
    """Binary digits of the number of words, 1 for none: what a document weighs within its source."""
    return F.length(F.bin("size")).cast("long")


def targets(sizes: DataFrame, cycle: int, most: int) -> DataFrame:
    """source, source_size, target of the classes' sources: weights 1..cycle repeat over the sources by code point, null last.

    The targets share all words by weight. None exceeds ``most`` times its
    source's size; the excess is shared again by weight until none is above.
    That is one water level: with the sources in order of the level at which
    each is full, the first whose own share at the level left by those before
    it fits gives the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy("full_at", "rank")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    return (
        sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", (F.pmod(F.col("rank") - 1, F.lit(cycle)) + 1).cast("long"))
        .withColumn("most", F.col("source_size") * most)
        .withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("at", F.col("left").cast("double") / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("at") <= F.col("full_at"), F.struct("full_at", "rank", "at"))).over(everything)["at"])
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def shares(classes: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """What a document of each class (source, digits, words) is due: whole copies, and the share of one more.

    The copies rise with the digits at one level for each source, and none
    exceeds ``most``. Classes fill up by falling digits; the first whose own
    level, given what those before it hold, does not fill it sets the level.
    """
    order = Window.partitionBy("source").orderBy(F.desc("digits"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    source = Window.partitionBy("source")
    return (
        _null_safe(classes, goals, ["source"])
        .withColumn("left", F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("at", F.try_divide(F.col("left"), F.sum(F.col("words") * F.col("digits")).over(after).cast("double")))
        .withColumn("level", F.min(F.when(F.col("at") <= F.lit(float(most)) / F.col("digits"), F.struct((-F.col("digits")).alias("digits"), "at"))).over(source))
        .withColumn("expected", F.when(F.col("digits") <= -F.col("level.digits"), F.least(F.lit(float(most)), F.col("level.at") * F.col("digits"))).otherwise(F.lit(float(most))))
        .withColumn("expected", F.when(F.col("source_size") > 0, F.col("expected")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("expected"))
        .withColumn("share", F.col("expected") - F.col("whole"))
        .withColumn("rest", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(source))
        .select("source", "digits", "source_size", "target", "whole", "share", "rest")
    )


def plan(docs: DataFrame, cycle: int, most: int, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sized documents, and a row for each class of a source with its copies and the cut of its source's order."""
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            _text_key(F.col(text_col)).alias("text"), F.monotonically_increasing_id().alias("row"),
        ).withColumn("same", F.struct("id", "source", "text")),
        "mix-rows",
    )
    sizes = cut(numbered(rows).select("id", "source", "size", "text", "k", _uniform().alias("u"), _digits().alias("digits")), "mix-sizes")
    classes = cut(sizes.groupBy("source", "digits").agg(F.sum("size").alias("words")), "mix-classes")
    goals = cut(shares(classes, targets(classes, cycle, most), most), "mix-goals")
    n_classes = goals.count()
    ranked = ranked_by_odds(sizes, goals, n_classes).where("share > 0")
    running = Window.partitionBy("source").orderBy("cell")
    cells = (
        ranked.groupBy("source", "rest", "cell").agg(F.sum("size").alias("words"))
        .withColumn("upto", F.sum("words").over(running))
        .where((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        .select("source", "cell", (F.col("upto") - F.col("words")).alias("before"))
    )
    order = Window.partitionBy("source").orderBy("place")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cuts = (
        _null_safe(ranked, _small(cells, n_classes), ["source", "cell"])
        .withColumn("upto", upto)
        .groupBy("source", "before", "rest", F.col("cell").alias("cut_cell"))
        .agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("upto", "place"))).alias("last"))
        .select(
            "source", "cut_cell", F.col("last.place").alias("cut_place"),
            (F.col("rest") - F.coalesce(F.col("last.upto"), F.col("before"))).alias("missing"),
        )
    )
    info = cut(_null_safe(goals, cuts, ["source"], "left"), "mix-cuts")
    miss = F.abs(F.col("size") - F.col("missing"))
    gaps = (
        ranked_by_odds(sizes, info, n_classes).where(F.col("cut_cell").isNotNull() & ~_in_prefix() & (F.col("share") > 0) & (miss < F.col("missing")))
        .groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "place")).alias("gap"))
        .select("source", F.col("gap.place").alias("gap_place"))
    )
    return sizes, cut(_null_safe(info, gaps, ["source"], "left"), "mix-gaps")


def _in_prefix() -> Column:
    """Whether a ranked document gets the extra copy by its place in the order.

    A source whose words all fit has no cut and takes every extra copy.
    """
    upto = F.coalesce(F.col("place") <= F.col("cut_place"), F.lit(False))
    before = F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell"))
    return (F.col("share") > 0) & (before | ((F.col("cell") == F.col("cut_cell")) & upto))


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns where null equals null, and keep the left ones."""
    renamed = right.withColumnsRenamed({c: f"{c}__right" for c in on})
    same = [left[c].eqNullSafe(renamed[f"{c}__right"]) for c in on]
    return left.join(renamed, same, how).drop(*[f"{c}__right" for c in on])


def ranked_by_odds(sizes: DataFrame, goals: DataFrame, n_classes: int) -> DataFrame:
    """Each document with its class's figures, its place in the order, odds first, and their cell, 0 to CELLS - 1."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("share") / (1 - F.col("share")))
    return (
        _null_safe(sizes, _small(goals, n_classes), ["source", "digits"])
        .withColumn("odds", F.when(F.col("share") > 0, odds))
        .withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(F.lit(CELLS) * F.col("odds") / (1 + F.col("odds")))).cast("int"))
        .withColumn("place", F.struct("odds", "id", "size", "text", "k"))
    )


def with_copies(sizes: DataFrame, info: DataFrame) -> DataFrame:
    """Add ``copies``: the whole ones, and one more for the prefix and for the closing document."""
    closing = F.coalesce(F.col("place") == F.col("gap_place"), F.lit(False))
    extra = F.coalesce(_in_prefix(), F.lit(False)) | closing
    return ranked_by_odds(sizes, info, info.count()).withColumn("copies", F.col("whole").cast("int") + extra.cast("int"))


def taken(docs: DataFrame, cycle: int = 3, most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """What the mix takes of every document, in words.

    Returns id_col, size (words of the text), source_size, target and taken
    (size times copies, at most ``most`` times size). Null and empty texts have
    size 0 and take nothing. Rows without a source form a source of their own,
    last in order; rows without an id are drawn by their text. Repeated rows
    and ids are documents of their own, each with its own draw. Ties of draws
    go by id, size, text key and counter. Sources without words get target 0.
    Texts of any length are counted whole. Other columns are left out; an
    empty table gives no rows.
    """
    sizes, info = plan(docs, cycle, most, id_col, source_col, text_col)
    return with_copies(sizes, info).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame, cycle: int = 3, most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it, with all its columns.

    Rows without words (null, empty) are taken like their class. Rows equal in
    id, source and text are told apart by a counter, whichever comes first;
    only such rows are shuffled. Columns may have any names. An empty table
    gives no rows.
    """
    names = docs.columns
    sizes, info = plan(docs, cycle, most, id_col, source_col, text_col)
    repeats = cut(sizes.groupBy(F.struct("id", "source", "text").alias("same")).count().where("count > 1").select("same"), "mix-repeats")
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), _text_key(F.col(text_col)).alias("text"),
    ).withColumn("same", F.struct("id", "source", "text"))
    placed = whole.join(repeats, "same", "left_anti").withColumn("k", F.lit(0).cast("long"))
    if not repeats.isEmpty():
        more = cut(whole.join(repeats, "same", "left_semi").withColumn("row", F.monotonically_increasing_id()), "mix-repeated")
        placed = placed.unionByName(numbered(more).select(*placed.columns))
    return (
        with_copies(placed.withColumns({"u": _uniform(), "digits": _digits()}), info)
        .where("copies > 0")
        .select("row_", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select("row_.*")
    )


SQL = r"""
WITH raw AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(text), 1, 15))::BIGINT AS t
  FROM documents),
counted AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, source, t) - 1 AS k FROM raw),
sized AS (
  SELECT *, length(bin(size)) AS digits,
         (('0x' || substr(md5(concat_ws(':', COALESCE(doc_id::VARCHAR, 'null'), COALESCE(t::VARCHAR, 'null'), k::VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE)
         / 4503599627370496.0::DOUBLE AS u
  FROM counted),
sources AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM named),
filled AS (SELECT *, most::DOUBLE / weight::DOUBLE AS full_at FROM weighed),
levels AS (
  SELECT *, ((SUM(source_size) OVER ()) - COALESCE(SUM(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (SUM(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own_level
  FROM filled),
level AS (SELECT own_level AS level FROM levels WHERE own_level <= full_at ORDER BY full_at, rank LIMIT 1),
goals AS (
  SELECT source, source_size, LEAST(most::DOUBLE, level * weight::DOUBLE) AS target
  FROM filled, level),
classes AS (SELECT source, digits, SUM(size)::BIGINT AS words FROM sized GROUP BY source, digits),
steps AS (
  SELECT c.source, c.digits, c.words, g.source_size, g.target,
         g.target - 3.0::DOUBLE * COALESCE(SUM(words) OVER (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_,
         (SUM(words * digits) OVER (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS slope
  FROM classes c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source),
tried AS (SELECT *, CASE WHEN slope > 0 THEN left_ / slope END AS own FROM steps),
best AS (
  SELECT source, max(digits) AS from_, arg_max(own, digits) AS own FROM tried WHERE own <= 3.0::DOUBLE / digits::DOUBLE GROUP BY source),
due AS (
  SELECT t.*, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE WHEN t.digits <= b.from_ THEN LEAST(3.0::DOUBLE, b.own * t.digits::DOUBLE) ELSE 3.0::DOUBLE END AS expected
  FROM tried t LEFT JOIN best b ON t.source IS NOT DISTINCT FROM b.source),
shares AS (
  SELECT *, FLOOR(expected)::BIGINT AS whole, expected - FLOOR(expected) AS share,
         target - (SUM(FLOOR(expected)::BIGINT * words) OVER (PARTITION BY source))::DOUBLE AS rest
  FROM due),
ranked AS (
  SELECT d.doc_id, d.source, d.size, d.t, d.k, s.source_size, s.target, s.whole, s.share, s.rest,
         (d.u / (1.0::DOUBLE - d.u)) / (CASE WHEN s.share > 0 THEN s.share END / (1.0::DOUBLE - s.share)) AS odds
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source AND d.digits = s.digits),
summed AS (
  SELECT *, (SUM(CASE WHEN share > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds NULLS FIRST, doc_id NULLS FIRST, size, t NULLS FIRST, k
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS upto
  FROM ranked),
gap AS (
  SELECT source, MAX(rest) - COALESCE(MAX(CASE WHEN upto <= rest THEN upto END), 0.0::DOUBLE) AS missing
  FROM summed WHERE share > 0 GROUP BY source),
closing AS (
  SELECT source, doc_id, t, k FROM (
    SELECT s.source, s.doc_id, s.t, s.k, ROW_NUMBER() OVER (PARTITION BY s.source ORDER BY ABS(s.size::DOUBLE - g.missing), s.odds, s.doc_id NULLS FIRST, s.size, s.t NULLS FIRST, s.k) AS nth
    FROM summed s JOIN gap g ON s.source IS NOT DISTINCT FROM g.source
    WHERE s.share > 0 AND s.upto > s.rest AND ABS(s.size::DOUBLE - g.missing) < g.missing)
  WHERE nth = 1)
SELECT s.doc_id, s.size, s.source_size, s.target,
       (s.size * (s.whole + CASE WHEN s.share > 0 AND (s.upto <= s.rest OR c.k IS NOT NULL) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed s LEFT JOIN closing c ON s.source IS NOT DISTINCT FROM c.source AND s.doc_id IS NOT DISTINCT FROM c.doc_id AND s.t IS NOT DISTINCT FROM c.t AND s.k = c.k
"""
