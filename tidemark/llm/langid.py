"""Language identification by compression.

Each language gets a zstandard raw-content dictionary cut from sample texts.
A text is lower-cased and compressed, in blocks, once with each dictionary; the language
whose dictionary gives the fewest bytes is chosen. The margin to the runner-up
says how sure that is; a narrow one marks the text as rejected.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.common import map_arrow, per_task, remainder

#: Documents sampled for each language (expected), and characters drawn from all of them for its dictionary.
SAMPLE_DOCS, DICTIONARY_CHARS = 256, 96 * 1024
#: Bytes of a text that are compressed at once. Short blocks lean on the dictionary.
BLOCK = 4096
#: Bytes by which the best must beat the runner-up to be accepted, and the share of the runner-up's bytes.
MIN_BYTES, MIN_SHARE = 1, 0.002
#: Margin, as a share of the runner-up's bytes, at which the score is 1 - 1/e.
SURE = 0.03

LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language that has a text with a letter, from a bounded sample of labelled rows.

    About SAMPLE_DOCS rows of each language are drawn by a hash of their id and
    text, and of each a span of equal length that starts anywhere in the text,
    so that dictionaries hold some DICTIONARY_CHARS characters: bounded
    parameters of the fit. Rows without text or language are not learned from;
    rows without id, repeated rows and empty texts are drawn like any other.
    What the driver holds grows with the number of languages alone.
    """
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return {}
    figures = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["count"])])
    mark = F.xxhash64("id", "text")
    chars = F.ceil(F.lit(DICTIONARY_CHARS) / F.least(F.col("rows"), F.lit(SAMPLE_DOCS))).cast("int")
    start = F.pmod(F.xxhash64("text", "id"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int")
    rows = (
        known.withColumn("rows", F.try_element_at(figures, F.col("lang")))
        .where(F.pmod(mark, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.lit(SAMPLE_DOCS) / F.col("rows"))
        .select("lang", "id", F.substring("text", start + 1, chars).alias("text"))
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.id or "", r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    return {lang: "\n".join(own).lower().encode() for lang, own in texts.items() if any(map(LETTER.search, own))}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = {}
        for lang in sorted(dictionaries):
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = zstandard.ZstdCompressionParameters.from_level(
                7, strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=18, write_content_size=False, write_dict_id=False
            )
            content.precompute_compress(compression_params=options)
            self.coders[lang] = zstandard.ZstdCompressor(dict_data=content, compression_params=options)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is wide enough."""
        if not text or not self.coders or not LETTER.search(text):
            return "und", 0.0, False
        data = text.lower().encode()
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.coders.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        (best, lang), (second, _) = sizes[:2]
        share = (second - best) / second
        return lang, 1 - math.exp(-share / SURE), second - best >= MIN_BYTES and share >= MIN_SHARE


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """The language of every whole text, however long, in blocks of BLOCK bytes.

    Returns id_col, lang_pred, score (0 to 1) and accepted (false where the
    margin is narrow). Null and empty texts, and texts without a letter, get
    ``und`` with score 0, not accepted; so do all texts if no language was
    learned. Equal sizes go to the language first in code point order, not
    accepted. Repeated rows are kept. ``keep`` names columns to carry along
    instead of id_col, others are left out; ``names`` are those of the three
    new columns, and a carried column of the same name gives way. Nothing is shuffled; an empty table gives no rows.
    """
    carried = [c for c in ([id_col] if keep is None else keep) if c not in names]
    def make():
        classify = Classifier(dictionaries)

        def step(t: pa.Table) -> pa.Table:
            found = [classify(x) for x in t.column(t.num_columns - 1).to_pylist()]
            columns = {f"c{i}": t.column(i) for i in range(len(carried))}
            columns |= {"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64()), "accepted": pa.array([x[2] for x in found], pa.bool_())}
            return pa.table(columns)

        return step

    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col(f"`{text_col}`").alias("t"))
    schema = StructType([StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carried)])
    schema = schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    out = map_arrow(source, per_task(make), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *[F.col(a).alias(b) for a, b in zip(("lang_pred", "score", "accepted"), names)])


def held_out(doc_id, of: int = 3, left: int = 1):
    """Rows that the query never learns from."""
    return F.coalesce(remainder(doc_id, of) == left, F.lit(False))
