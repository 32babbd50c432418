"""Line deduplication over a corpus.

Lines are exploded with their positions, normalised and hashed; the documents
of each hash are counted, and lines in enough documents are dropped everywhere
but in the first one. Only hashes travel to the counts, and only positions back
to the texts, which are cut anew from their whole text, by position.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: The six ASCII white-space characters.
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z lower-cased.

    ``lower`` alone would fold other letters too, so it serves ASCII lines only.
    """
    bare = F.trim(line, F.lit(SPACE))
    folded = F.translate(bare, ascii_uppercase, ascii_lowercase)
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(folded)


def repeated_keys(keys: DataFrame, min_docs: int = 2) -> DataFrame:
    """The hashes (h1, h2) of ``keys`` (h1, h2, id) in at least ``min_docs`` documents, with ``least``, the smallest id.

    Everything is summed up before the shuffle, so a line of every document is
    one row of each task. Rows of equal ids are one document, and so are rows
    without id, after all others. At two documents the extremes of the ids
    tell as much as a count of distinct ones.
    """
    if min_docs > 2:
        keys = keys.distinct()
    counts = keys.groupBy("h1", "h2").agg(
        F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.col("id").isNull()).alias("nameless"), F.count("*").alias("n_docs")
    )
    several = (F.col("least") != F.col("most")) | (F.col("nameless") & F.col("least").isNotNull())
    # least is null where nameless rows alone hold a line: they are one document
    return counts.where(several if min_docs == 2 else (F.col("n_docs") >= min_docs) & several).select("h1", "h2", "least")


def deduplicate_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop the lines that stand in several documents, but for the document of the smallest id.

    Returns id_col, n_lines (before), n_dropped and text_col, the lines left
    joined by line ends. Lines are cut at ``\\n``; a null or empty text is one
    empty line. Keys (see ``line_key``) of under ``min_chars`` code points are
    never dropped; those found in ``min_docs`` (2 or more) documents or more
    lose all their lines except in the smallest id that holds them, where all
    stay, repeated ones too. A text that loses every line becomes empty. Rows
    that share an id are one document and are treated alike; rows without id
    are one document that comes last. Keys are compared by 128 bits of hash.
    Other columns are left out, so none can clash. An empty table gives none.
    A text of any length is one row; a task holds the positions of its lines.
    """
    if min_docs < 2:
        raise ValueError("a line must stand in two documents at least to be a repeat")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("print"), F.split(text, "\n", -1).alias("lines"))
    lines = rows.select("id", "print", F.posexplode("lines").alias("at", "line")).select("id", "print", "at", line_key(F.col("line")).alias("key"))
    lines = lines.where(F.length("key") >= min_chars)
    hashed = lines.select("id", "print", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    repeated = cut(repeated_keys(hashed.select("h1", "h2", "id"), min_docs), "lines-repeated")
    gone = (
        hashed.join(repeated, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("least")))
        .groupBy(F.col("id").alias("of"), F.col("print").alias("of_print"))
        .agg(F.collect_set("at").alias("gone"))  # of one text: rows equal in id and text lose the same positions
    )
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("print") == F.col("of_print")), "left")
    n_lines, n_gone = F.size("lines"), F.coalesce(F.size("gone"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.transform(stay, lambda i: F.get("lines", i))
    return joined.select(
        F.col("id").alias(id_col), n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(n_gone).cast("long").alias("n_dropped"),
        F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias(text_col),
    )


SQL = f"""
WITH l AS (
  SELECT doc_id, row_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS row_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key FROM l),
r AS (SELECT key, MIN(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, COALESCE(k.doc_id <> r.least, FALSE) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id, row_id
"""
