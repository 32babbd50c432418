"""Timed objects: text charts, token streams, order rules, ready windows, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import lane_actions

# Object kinds.
TAP, START, END = "tap", "holdStart", "holdEnd"


def parse_sections(charts: DataFrame) -> DataFrame:
    """Lines of whole text charts: chart_id, line_no, section, line; blanks and comments left out.

    charts: chart_id, text. A chart is one document; its lines are numbered by
    position and a section holds until the next ``[Name]`` line.
    """
    lines = charts.select("chart_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    name = F.when(F.col("line").rlike(r"^\[.+\]$"), F.regexp_extract("line", r"^\[(.+)\]$", 1))
    so_far = Window.partitionBy("chart_id").orderBy("line_no")
    return (
        lines.withColumn("section", F.last(name, ignorenulls=True).over(so_far))
        .where((F.col("line") != "") & ~F.startswith("line", F.lit("//")) & name.isNull())
    )


def parse_pairs(lines: DataFrame) -> DataFrame:
    """chart_id, line_no, section, key, value of the ``key: value`` lines."""
    at = F.instr("line", ":")
    pairs = lines.where((F.col("section") != "HitObjects") & (at > 0))
    return pairs.select("chart_id", "line_no", "section", F.trim(F.left("line", at - 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))


# The mode and the number of lanes that are read.
MODE, LANES = 3, 4


def chart_headers(charts: DataFrame, pairs: DataFrame) -> DataFrame:
    """chart_id, title, artist and problem of every chart (chart_id, text), by its pairs; of a repeated key the last counts.

    problem: ``unsupportedMode`` unless Mode is 3, else ``unsupportedKeyCount``
    unless CircleSize is 4. Names in Unicode come first; without a title the file
    name's stem is taken.
    """
    asked = {"mode": ("General", "Mode"), "size": ("Difficulty", "CircleSize"), "title_u": ("Metadata", "TitleUnicode"), "title_a": ("Metadata", "Title"), "artist_u": ("Metadata", "ArtistUnicode"), "artist_a": ("Metadata", "Artist")}
    last = lambda section, key: F.max_by(F.when((F.col("section") == section) & (F.col("key") == key), F.col("value")), F.when((F.col("section") == section) & (F.col("key") == key), F.col("line_no")))
    found = charts.select("chart_id").join(pairs.groupBy("chart_id").agg(*[last(*names).alias(c) for c, names in asked.items()]), "chart_id", "left")
    mode, size = F.col("mode").try_cast("int"), F.col("size").try_cast("double")
    problem = F.when(F.coalesce(mode != MODE, F.lit(True)), "unsupportedMode").when(F.coalesce(F.abs(size - LANES) >= 0.0001, F.lit(True)), "unsupportedKeyCount")
    stem = F.regexp_replace(F.element_at(F.split("chart_id", "/"), -1), r"\.[^.]*$", "")
    return found.select("chart_id", F.coalesce("title_u", "title_a", stem).alias("title"), F.coalesce("artist_u", "artist_a").alias("artist"), problem.alias("problem"))


def parse_objects(lines: DataFrame) -> DataFrame:
    """Objects of the ``HitObjects`` lines, with ``problem`` where a line is rejected.

    Type bit 1 is a tap, bit 128 a hold; bits 2 and 8, both or neither of these
    kinds and unreadable numbers are problems. The lane is the quarter of 512
    that x lies in. A hold gives two rows and never ends before it starts.
    """
    p = F.split("line", ",")
    number = lambda k: F.get(p, F.lit(k)).try_cast("double")
    bits = F.get(p, F.lit(3)).try_cast("int")
    rows = lines.where("section = 'HitObjects'").select(
        "chart_id", "line_no", number(0).alias("x"), number(2).alias("time_ms"), bits.alias("bits"),
        F.split(F.get(p, F.lit(5)), ":")[0].try_cast("double").alias("end_ms"),
    )
    tap, hold = F.col("bits").bitwiseAND(1) > 0, F.col("bits").bitwiseAND(128) > 0
    problem = (
        F.when(F.col("x").isNull() | F.col("time_ms").isNull() | F.col("bits").isNull(), "unreadable")
        .when(F.col("bits").bitwiseAND(2 | 8) > 0, "unsupported").when(tap & hold, "unsupported").when(~tap & ~hold, "unsupported")
    )
    lane = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(F.col("x") * 4 / 512))).cast("int")
    end = F.greatest(F.col("time_ms"), F.coalesce("end_ms", "time_ms"))
    item = lambda kind, t, k: F.struct(F.lit(kind).alias("kind"), t.alias("time_ms"), F.lit(k).alias("part"))
    items = F.when(problem.isNotNull() | tap, F.array(item(TAP, F.col("time_ms"), 0))).otherwise(
        F.array(item(START, F.col("time_ms"), 0), item(END, end, 1))
    )
    return rows.select("chart_id", "line_no", lane.alias("lane"), problem.alias("problem"), F.inline(items))


def stream_order() -> list[Column]:
    """Time, lane, source line, part."""
    return [F.asc("time_ms"), F.asc("lane"), F.asc("line_no"), F.asc("part")]


def chart_summary(objects: DataFrame) -> DataFrame:
    """Objects without hold ends, and the last time."""
    return objects.groupBy("chart_id").agg(F.count_if(F.col("kind") != END).alias("objects"), F.max("time_ms").alias("duration_ms"))


def decode_tokens(tokens: DataFrame) -> DataFrame:
    """Lane events of tokens (session_id, token_id, time): action 1 tap, 2 hold start, 3 hold end."""
    kind = F.element_at(F.array(F.lit(TAP), F.lit(START), F.lit(END)), F.col("x.action"))
    return (
        tokens.select(*tokens.columns, F.explode(lane_actions(F.col("token_id"))).alias("x"))
        .select(*tokens.columns, F.col("x.lane").alias("lane"), kind.alias("kind"))
    )


def violations(objects: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """The first broken order rule of each lane's stream: negative time, overlap, open hold, end without start.

    ``order`` totally orders the rows of a key. Two starts of a lane at one time
    overlap; a start within an open hold and an end without one break the lane.
    """
    lane = Window.partitionBy(key, "lane").orderBy(time, *order)
    starts = F.col("kind").isin(TAP, START)
    # An open hold: the last hold mark before this row is a start.
    mark = F.when(F.col("kind").isin(START, END), F.col("kind"))
    before = F.last(mark, ignorenulls=True).over(lane.rowsBetween(Window.unboundedPreceding, -1))
    rule = (
        F.when(F.col(time) < 0, "negative_time")
        .when(starts & (F.lag("kind").over(lane) != END) & (F.lag(time).over(lane) == F.col(time)), "overlap")
        .when(starts & (before == START), "start_in_hold")
        .when((F.col("kind") == END) & F.coalesce(before != START, F.lit(True)), "end_without_start")
    )
    broken = objects.withColumn("rule", rule).where("rule is not null")
    first = F.min(F.struct(time, *order, "lane", "rule")).alias("x")
    return broken.groupBy(key).agg(first, F.count("*").alias("broken")).select(key, F.col(f"x.{time}").alias(time), F.col("x.lane").alias("lane"), F.col("x.rule").alias("rule"), "broken")


def pair_holds(objects: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """Each hold start with the end that follows it in its lane; an open one has no end."""
    lane = Window.partitionBy(key, "lane").orderBy(time, *order)
    marks = objects.where(F.col("kind").isin(START, END))
    ends = F.when(F.lead("kind").over(lane) == END, F.lead(time).over(lane))
    return marks.withColumn("end", ends).where(F.col("kind") == START).select(key, "lane", *order, F.col(time).alias("start"), "end")


def next_start(objects: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """The next starting object of the lane, which locks this one from then on."""
    lane = Window.partitionBy(key, "lane").orderBy(time, *order)
    return objects.where(F.col("kind") != END).withColumn("locked_at", F.lead(time).over(lane))


def with_ordinal(objects: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """Ordinal from 0 over all but hold ends; an end has none."""
    w = Window.partitionBy(key).orderBy(time, *order)
    n = F.count_if(F.col("kind") != END).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return objects.withColumn("ordinal", F.when(F.col("kind") != END, n - 1))


def ready_window(objects: DataFrame, key: str, time: str, order: list[str], minimum: Column | None = None) -> DataFrame:
    """From the first object to the last time at which no lane is held; null if there is none.

    All objects of one time count together. With ``minimum`` the window starts
    at the first time from there on before which no lane was held.
    """
    lane = Window.partitionBy(key, "lane").orderBy(time, *order)
    held = F.last(F.when(F.col("kind") == START, 1).when(F.col("kind") == END, 0), ignorenulls=True)
    after = F.coalesce(held.over(lane.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    before = F.coalesce(held.over(lane.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moves = objects.withColumn("change", after - before)
    times = moves.groupBy(key, time).agg(F.sum("change").alias("change"))
    along = Window.partitionBy(key).orderBy(time)
    times = times.withColumn("open", F.sum("change").over(along)).withColumn("open_before", F.col("open") - F.col("change"))
    start = F.lit(True) if minimum is None else (F.col(time) >= minimum) & (F.col("open_before") == 0)
    bounds = times.groupBy(key).agg(
        F.min(F.when(start, F.col(time))).alias("start"), F.max(F.when(F.col("open") == 0, F.col(time))).alias("last_closed")
    )
    ok = F.col("last_closed") >= F.col("start")
    return bounds.select(key, F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("last_closed")).alias("end"))


def start_gate(objects: DataFrame, key: str, time: str, order: list[str], now: Column, buffered_ms: int = 5000, lead_ms: int = 1000) -> DataFrame:
    """Whether rendering may start: the window from ``lead_ms`` after ``now`` on, and ``ready`` once it is long enough."""
    window = ready_window(objects, key, time, order, now + lead_ms)
    return window.withColumn("ready", F.coalesce(F.col("end") - F.col("start") >= buffered_ms, F.lit(False)))


def accepted(objects: DataFrame, time: str, least: Column | None = None, most: Column | None = None, rendered_to: Column | None = None) -> DataFrame:
    """Objects that may still be taken: finite times from 0 on, within the bounds, and after what was rendered, where these are known.

    The same filter prunes what was taken before, when a bound changes.
    """
    at = F.col(time).cast("double")
    ok = F.coalesce((at >= 0) & (at < float("inf")) & ~F.isnan(at), F.lit(False))
    for bound, inside in ((least, lambda b: at >= b), (most, lambda b: at <= b), (rendered_to, lambda b: at > b)):
        if bound is not None:
            ok = ok & F.coalesce(inside(bound), F.lit(True))
    return objects.where(ok)


def ended(marks: DataFrame, key: str, complete_to: str) -> DataFrame:
    """When each stream ends: the earliest declared time; times that are not finite or below 0 declare nothing."""
    at = F.col(complete_to).cast("double")
    return marks.where((at >= 0) & (at < float("inf")) & ~F.isnan(at)).groupBy(key).agg(F.min(complete_to).alias("end_ms"))


def page(rows: DataFrame, key: str, order: list[str], after: int, limit: int, bound: Column) -> DataFrame:
    """Rows after a cursor up to ``bound``, ``limit`` at most for each key.

    ``complete_before`` is the time up to which, not including it, the page is
    whole: null if it was not cut by the limit.
    """
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") > after).where(bound)
    next_time = F.lead(order[0]).over(w)
    return (
        numbered.withColumn("next", next_time).where(F.col("position") <= after + limit)
        .withColumn("complete_before", F.when(F.max("position").over(Window.partitionBy(key)) == after + limit, F.max(F.when(F.col("position") == after + limit, F.col("next"))).over(Window.partitionBy(key))))
        .drop("next")
    )


def not_yet_sent(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Multiset difference: an object sent twice cancels two equal ones."""
    return rows.exceptAll(sent)


def visible(objects: DataFrame, start: str, end: str, low: Column, high: Column, keep_ms: int = 300) -> DataFrame:
    """Objects whose interval meets [low, high], and resolved ones for ``keep_ms`` more."""
    meets = (F.col(start) <= high) & (F.coalesce(end, start) >= low)
    lingering = F.col("resolved_at").isNotNull() & (F.col("resolved_at") + keep_ms >= low) & (F.col("resolved_at") <= high)
    return objects.where(meets | F.coalesce(lingering, F.lit(False)))


def frame_timing(rows: DataFrame, audio: str, audio_offset: int, visual_offset: int, scroll: Column) -> DataFrame:
    """Gameplay, render and read-through times of audio times."""
    game = F.col(audio) + audio_offset
    render = game + visual_offset
    return rows.withColumns({"gameplay_ms": game, "render_ms": render, "read_through_ms": F.greatest(game, render) + scroll + 250})
