"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with
that speaker as the assistant, all others as named users and system turns as
they are; the mask marks what the assistant says. Only a dialogue of more turns
than a row should hold comes in several rows, which ``joined`` puts together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Turn numbers of a part, and turns from which a part, which must repeat numbers then, is dealt into pieces.
PART_TURNS, PIECE_ROWS = 4096, 4096
#: A null role; no role can have this name once it is escaped.
SYSTEM, UNKNOWN = "system", "|unknown"
END = "\n<|end|>\n"
ASSISTANT = "<|assistant|>\n"


def _segment(speaker: Column, text: Column, perspective: Column) -> Column:
    head = (
        F.when(speaker == SYSTEM, F.lit("<|system|>\n"))
        .when(speaker == perspective, F.lit(ASSISTANT))
        .otherwise(F.concat(F.lit("<|user name="), speaker, F.lit("|>\n")))
    )
    return F.concat(head, text, F.lit(END))


def _escaped(name: Column) -> Column:
    """A name that can neither end its mark nor its line; different names stay different."""
    for a, b in (("\\", "\\\\"), ("|", "\\p"), ("\n", "\\n"), ("\r", "\\r")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return name


def _pieces(rows: DataFrame) -> DataFrame:
    """Add ``piece`` and ``copies``: a part is whole (piece 0) up to PIECE_ROWS turns.

    A larger one is cut in the order of its turns: by turn number, within a
    number by the tie key, and equal turns by count. So pieces are bounded,
    deterministic, and in order make up the part.
    """
    counts = rows.groupBy("conv", "part", "turn").count()
    large = cut(counts.groupBy("conv", "part").agg(F.sum("count").alias("n")).where(F.col("n") > PIECE_ROWS).select("conv", "part"), "chat-large")
    whole = rows.join(large, ["conv", "part"], "left_anti").withColumns({"piece": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    if large.isEmpty():
        return whole
    within = counts.join(large, ["conv", "part"]).select("conv", "part", "turn", F.ceil(F.col("count") / PIECE_ROWS).alias("buckets"))
    equal = rows.join(large, ["conv", "part"], "left_semi").groupBy(*rows.columns).count()
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / PIECE_ROWS)))
    dealt = equal.join(within, ["conv", "part", "turn"]).select("*", chunk.alias("chunk"))
    offset = F.coalesce(F.pmod(F.col("turn.turn"), F.lit(PART_TURNS)), F.lit(0))
    # within a turn number, beyond the first bucket of ties each set of equal turns is cut by count
    order = F.shiftleft(offset.cast("long"), 48) + F.shiftleft(F.floor(F.col("tie") * F.col("buckets") / F.lit(1 << 32)), 24)
    left = F.col("count") - F.col("chunk") * PIECE_ROWS
    return whole.unionByName(dealt.withColumn("piece", order + F.col("chunk")).withColumn("copies", F.least(left, F.lit(PIECE_ROWS))).select(*whole.columns))


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Every conversation from the perspective of each of its participants.

    Returns conv_col, perspective, part, piece, n_turns, text and mask: the
    spans ``start:end`` of the assistant's words and end marks, in code points
    of the row's text, joined by commas. A dialogue is one row (part 0, piece
    0) unless its turn numbers reach PART_TURNS (part is the number divided by
    that) or a part has more than PIECE_ROWS turns; ``joined`` joins such rows
    exactly. Turns are ordered by number, turns that share one by a hash of
    speaker and text. Participants are the speakers but ``system``; a null role
    is a speaker of its own. In names ``\\``, ``|`` and line ends are escaped
    by ``\\``; null texts count as empty; ``<|`` within a text is broken up, so
    that no text can pose as a mark. Turns without a number form a part of
    their own (null), rows without a conversation one conversation (null).
    Repeated rows are rendered each. A conversation of system turns alone has
    no participant and gives no rows, nor does an empty table. Other columns
    are left out.
    """
    speaker = F.coalesce(_escaped(F.col(role_col)), F.lit(UNKNOWN))
    text = F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |"))
    # nulls within a struct are equal to each other
    rows = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),
        F.struct(F.floor(F.col(turn_col) / F.lit(PART_TURNS)).alias("part")).alias("part"),
        F.struct(F.col(turn_col).alias("turn")).alias("turn"),
        speaker.alias("speaker"),
        text.alias("text"),
        F.conv(F.substring(F.md5(F.concat_ws("|", speaker, text).cast("binary")), 1, 8), 16, 10).cast("long").alias("tie"),
    )
    dealt = _pieces(rows)
    parts = (
        dealt.groupBy("conv", "part", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "tie", "speaker", "text", "copies"))).alias("turns"), F.sum("copies").alias("n_turns"))
    )
    # speakers meet the small keys of the parts first, so a conversation's texts stay dealt by part
    speakers = rows.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("perspective")).distinct()
    keys = dealt.select("conv", "part", "piece").distinct().join(speakers, "conv")
    shown = parts.join(keys, ["conv", "part", "piece"])
    segments = F.flatten(F.transform("turns", lambda t: F.array_repeat(F.struct(_segment(t["speaker"], t["text"], F.col("perspective")).alias("s"), (t["speaker"] == F.col("perspective")).alias("mine")), t["copies"].cast("int"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    head = F.lit(len(ASSISTANT))
    spans = F.aggregate(
        "segments", start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["s"])).alias("at"),
            F.when(x["mine"], F.concat(acc["spans"], F.array(F.concat_ws(":", acc["at"] + head, acc["at"] + F.length(x["s"]))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )["spans"]
    return (
        shown.withColumn("segments", segments)
        .select(
            F.col("conv.id").alias(conv_col), "perspective", F.col("part.part").alias("part"), "piece", "n_turns",
            F.concat_ws("", F.transform("segments", lambda x: x["s"])).alias("text"), F.concat_ws(",", spans).alias("mask"),
        )
    )


def joined(rendered: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each dialogue and perspective: conv_col, perspective, n_turns, text and mask.

    Joins the rows of ``perspectives`` in order of part (null first) and piece
    and shifts their spans. A whole dialogue must fit a row. Null conversations
    are one; an empty table gives no rows.
    """
    order = F.array_sort(F.collect_list(F.struct("part", "piece", "text", "mask")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    shift = lambda at: lambda m: F.concat_ws(":", *[F.element_at(F.split(m, ":"), i).cast("int") + at for i in (1, 2)])
    spans = F.aggregate(
        "all", start,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["text"])).alias("at"),
            F.concat(acc["spans"], F.transform(F.filter(F.split(x["mask"], ","), lambda m: m != ""), shift(acc["at"]))).alias("spans"),
        ),
    )["spans"]
    return (
        rendered.groupBy(conv_col, "perspective").agg(F.sum("n_turns").alias("n_turns"), order.alias("all"))
        .select(conv_col, "perspective", "n_turns", F.concat_ws("", F.transform("all", lambda x: x["text"])).alias("text"), F.concat_ws(",", spans).alias("mask"))
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, floor(turn / 4096)::BIGINT AS part, turn,
         COALESCE(replace(replace(replace(replace(role, '\', '\\'), '|', '\p'), chr(10), '\n'), chr(13), '\r'), '|unknown') AS speaker,
         replace(COALESCE(text, ''), '<|', '< |') AS text
  FROM conversations),
o AS (SELECT *, substr(md5(speaker || '|' || text), 1, 8) AS tie FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT o.conv_id, p.perspective, o.part, o.turn, o.tie, o.speaker, o.text,
         CASE WHEN o.speaker = 'system' THEN '<|system|>' || chr(10)
              WHEN o.speaker = p.perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || o.speaker || '|>' || chr(10) END || o.text || chr(10) || '<|end|>' || chr(10) AS segment
  FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
m AS (
  SELECT *, SUM(length(segment)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, tie, speaker, text
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM s)
SELECT conv_id, perspective, part, 0::BIGINT AS piece, COUNT(*) AS n_turns,
       string_agg(segment, '' ORDER BY turn NULLS FIRST, tie, speaker, text) AS text,
       COALESCE(string_agg(CASE WHEN speaker = perspective THEN (upto - length(segment) + 14)::VARCHAR || ':' || upto::VARCHAR END, ',' ORDER BY turn NULLS FIRST, tie, speaker, text), '') AS mask
FROM m GROUP BY conv_id, perspective, part
"""
