"""Recognition results: loosely typed JSON into matches, and matches into tracks.

Fields are read by path from variants, so a field may be missing, null, or of
one of the forms that services use: one entry or a list, a name or an object
with a name, or with names by language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a scan's state code says.
STATES = {0: "Processing", 1: "Ready", -1: "No results", -2: "Error", -3: "Error"}


def one_or_many(value: Column, path: str) -> Column:
    """The first entry of a list at ``path``, or what is there itself, as a variant."""
    return F.coalesce(F.try_variant_get(value, f"{path}[0]", "variant"), F.try_variant_get(value, path, "variant"))


def trimmed(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def name_of(value: Column) -> Column:
    """A name given as text, as {name}, or as {langs: [name or {name}]}; else null."""
    is_text = F.schema_of_variant(value) == "STRING"
    inner = F.coalesce(F.try_variant_get(value, "$.langs[0].name", "string"), F.when(F.schema_of_variant(F.try_variant_get(value, "$.langs[0]", "variant")) == "STRING", F.try_variant_get(value, "$.langs[0]", "string")))
    return F.when(is_text, F.try_variant_get(value, "$", "string")).otherwise(F.coalesce(F.try_variant_get(value, "$.name", "string"), inner))


def matches(rows: DataFrame, json_col: str) -> DataFrame:
    """Add code, message and ``match`` of each response: the first music entry, null without an id or a title.

    Texts are trimmed and empty ones are null; artists without a name are left
    out. What does not parse gives nulls. All columns of ``rows`` are kept.
    """
    v, m = F.try_parse_json(F.col(json_col)), F.col("music__")
    text = lambda path: trimmed(F.try_variant_get(m, path, "string"))
    number = lambda path, kind: F.try_variant_get(m, path, kind)
    listed = F.coalesce(F.try_variant_get(m, "$.artists", "array<variant>"), F.array().cast("array<variant>"))
    artists = F.filter(F.transform(listed, lambda x: trimmed(name_of(x))), lambda x: x.isNotNull())
    match = F.struct(
        text("$.acrid").alias("match_id"), text("$.title").alias("title"), artists.alias("artists"), trimmed(name_of(F.try_variant_get(m, "$.album", "variant"))).alias("album"),
        number("$.duration_ms", "bigint").alias("duration_ms"), text("$.external_ids.isrc").alias("isrc"), number("$.score", "double").alias("score"),
        text("$.release_date").alias("release_date"), (number("$.play_offset_ms", "double") / 1000).alias("offset_s"), number("$.played_duration", "double").alias("played_s"),
    )
    found = rows.withColumns({"code": F.try_variant_get(v, "$.status.code", "int"), "message": F.try_variant_get(v, "$.status.message", "string"), "music__": one_or_many(v, "$.metadata.music")})
    return found.withColumn("match", F.when(text("$.acrid").isNotNull() & text("$.title").isNotNull(), match)).drop("music__")


def state_label(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.when(code.isNull(), "Unknown").otherwise(F.coalesce(F.try_element_at(known, code), F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")"))))


def snapshot(match: Column, source: str) -> Column:
    """The track of a match: id, title, artist, isrc, and where it was heard: from_s and to_s, null unless some of it was played."""
    played = match["played_s"] > 0
    return F.when(
        match.isNotNull(),
        F.struct(
            F.concat(F.lit(f"{source}:"), match["match_id"]).alias("track_id"), match["title"].alias("title"), F.array_join(match["artists"], ", ").alias("artist"), match["isrc"].alias("isrc"),
            match["offset_s"].alias("offset_s"), F.when(played, match["offset_s"]).alias("from_s"), F.when(played, match["offset_s"] + match["played_s"]).alias("to_s"),
        ),
    )
