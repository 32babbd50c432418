"""Text column functions: search keys, token similarity, slugs, flexible JSON values."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _folds() -> tuple[str, str]:
    """Accented Latin letters and their bases, by the rule of canonical decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _folds()


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(F.translate(F.regexp_replace(text, r"\p{M}", ""), _ACCENTED, _BASE))


def search_key(text: Column) -> Column:
    """Folded words of letters and digits with single spaces between; null counts as empty."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def code_key(text: Column) -> Column:
    """Folded letters and digits without anything between."""
    return F.regexp_replace(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def stem_key(file_name: Column) -> Column:
    """Search key of a file name without its last extension."""
    return search_key(F.regexp_replace(file_name, r"\.[^.]*$", ""))


def artist_parts(text: Column, marks: str = "[/,]") -> Column:
    """Distinct trimmed parts that are not empty, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), marks), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda x: x != ""))


def _contains(long: Column, short: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))


def contiguous(a: Column, b: Column) -> Column:
    """1 if one key's words stand together in the other, else 0."""
    some = (a != "") & (b != "")
    return F.when(some & (_contains(a, b) | _contains(b, a)), F.lit(1.0)).otherwise(F.lit(0.0))


def _n_words(key: Column) -> Column:
    return F.size(F.split(key, " "))


def token_score(a: Column, b: Column) -> Column:
    """Best of Jaccard, of the share of the smaller word set that is shared, times 0.92, and
    of words that stand together in a longer key: 0.86 for one word, 0.94 for more."""
    x, y = tokens(a), tokens(b)
    shared, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    short = F.least(_n_words(a), _n_words(b))
    inside = F.when(contiguous(a, b) == 1, F.when(short == 1, F.lit(0.86)).otherwise(F.lit(0.94))).otherwise(F.lit(0.0))
    share = lambda of: F.coalesce(F.try_divide(shared, of), F.lit(0.0))
    return F.greatest(share(every), share(F.least(F.size(x), F.size(y))) * 0.92, inside)


def holds(long: Column, short: Column) -> Column:
    """Whether the words of a key that is not empty stand together in ``long``."""
    return (short != "") & _contains(long, short)


def fuzzy(a: Column, b: Column) -> Column:
    """Similarity of two search keys: 0 if one is empty, 1 if equal, else the
    better of the token score and of edit distance over the longer length."""
    edits = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(token_score(a, b), edits))


def slug(text: Column, most: int = 80) -> Column:
    """Folded, runs of other characters become a dash, cut to ``most``, no dash at the ends."""
    dashed = F.regexp_replace(fold(text), r"[^a-z0-9]+", "-")
    return F.trim(F.left(F.trim(dashed, F.lit("-")), F.lit(most)), F.lit("-"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def first_integer(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")


def key_bindings(stored: Column, n: int = 4) -> Column:
    """Keys stored with tabs between: trimmed, in lower case; null unless they are ``n`` different ones."""
    keys = F.transform(F.split(stored, "\t"), lambda k: F.lower(F.trim(k)))
    ok = (F.size(keys) == n) & (F.size(F.array_distinct(keys)) == n) & ~F.array_contains(keys, "")
    return F.when(ok, keys)


def _stamped(at: Column, *parts: Column) -> Column:
    return F.concat_ws("-", *parts, F.date_format(at, "yyyyMMdd-HHmmss"))


def _or(name: Column, other: Column | str) -> Column:
    """A slug of any length, or something else where nothing is left of it."""
    return F.coalesce(blank_to_null(slug(name, 1 << 20)), F.lit(other) if isinstance(other, str) else other)


def recording_id(group: Column, take: Column, name: Column, at: Column) -> Column:
    """``group-take-yyyyMMdd-HHmmss`` as slugs; without a group its fallback name, without a take ``take``, without both names ``ambient-sync``."""
    return _stamped(at, _or(group, _or(name, "ambient-sync")), _or(take, "take"))


def clip_id(prefix: str, name: Column, at: Column) -> Column:
    """``prefix-name-yyyyMMdd-HHmmss``, the name as a slug without its extension; a name without letters or digits is ``fixture``."""
    return _stamped(at, F.lit(prefix), _or(F.regexp_replace(name, r"[.][^.]*$", ""), "fixture"))


def tag(tags: Column, identifiers: list[str], word: str) -> Column:
    """Value of the first identifier that has one that is not blank, else of the first tag whose name holds ``word``; tags: array of (id, name, value)."""
    filled = F.filter(tags, lambda t: blank_to_null(t["value"]).isNotNull())
    first = lambda test: F.get(F.filter(filled, test), 0)["value"]
    by_id = [first(lambda t: t["id"] == F.lit(i)) for i in identifiers]  # noqa: B023  (called at once)
    by_name = first(lambda t: F.contains(F.lower(t["name"]), F.lit(word)))
    return F.trim(F.coalesce(*by_id, by_name))


@F.pandas_udf(StringType())
def fnv1a(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes, as 16 hex digits; null stays null."""

    def one(x):
        h = 0xCBF29CE484222325
        for byte in x.encode():
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return text.map(one, na_action="ignore")


def signature(key: str):
    """A function of a text column: base64 of its HMAC-SHA1 under ``key``."""
    import base64
    import hashlib
    import hmac

    @F.pandas_udf(StringType())
    def sign(text: pd.Series) -> pd.Series:
        return text.map(lambda x: base64.b64encode(hmac.new(key.encode(), x.encode(), hashlib.sha1).digest()).decode(), na_action="ignore")

    return sign


def flexible_number(json: Column, path: str, kind: str = "int") -> Column:
    """A number given as number or text; fractions are truncated for whole kinds, else null."""
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def string_list(json: Column) -> Column:
    """A JSON array of strings; anything else gives an empty list."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def last_json_object(text: Column) -> Column:
    """The object that ends a mixed text: the suffix from the first brace from which it parses."""
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(1)) == "{")
    suffixes = F.transform(starts, lambda i: F.substring(text, i, F.greatest(n, F.lit(1))))
    return F.get(F.filter(suffixes, lambda s: F.try_parse_json(s).isNotNull()), F.lit(0))


def lane_actions(token: Column) -> Column:
    """Array of (lane, action 1 to 3) of a token from 25 to 279: base-4 digits, lane 0 lowest."""
    digit = lambda lane: F.pmod(F.floor((token - 24) / F.pow(F.lit(4.0), lane)), F.lit(4)).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda lane: F.struct(lane.alias("lane"), digit(lane).alias("action")))
    return F.when(token.between(25, 279), F.filter(every, lambda x: x["action"] > 0)).otherwise(F.filter(every, lambda x: F.lit(False)))


def all_tags(*forms: Column) -> Column:
    """The tag lists that a file has under several forms, one after the other; a form that is absent has none."""
    return F.flatten(F.filter(F.array(*forms), lambda x: x.isNotNull()))


# The codes of a file's status in the index.
STATUSES = ("ready", "missingFile", "unsupportedFormat", "unreadable", "metadataPartial", "failed")


def index_status(code: Column, message: Column) -> Column:
    """Struct of code and message: only failures have a message, and an unknown code is a failure that names it."""
    text = F.when(code == "failed", F.coalesce(message, F.lit("Unknown indexing failure."))).when(
        ~F.coalesce(code.isin(*STATUSES), F.lit(False)), F.concat(F.lit("Unknown indexing status: "), F.coalesce(code, F.lit("")))
    )
    return F.struct(F.when(text.isNull(), code).otherwise(F.lit("failed")).alias("code"), text.alias("message"))


def manual_query(title: Column, artist: Column, album: Column, duration: Column, isrc: Column) -> Column:
    """A query as typed: artists cut at ``,``, ``;`` and ``&``, a duration that is no whole number is null, the provider manual."""
    artists = F.filter(F.transform(F.split(F.coalesce(artist, F.lit("")), "[,;&]"), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.when(F.trim(duration).rlike(r"^[+-]?\d+$"), F.trim(duration).try_cast("long"))
    return F.struct(
        F.trim(title).alias("title"), artists.alias("artists"), blank_to_null(album).alias("album"), whole.alias("duration_ms"),
        blank_to_null(isrc).alias("isrc"), F.lit("manual").alias("provider"),
    )
