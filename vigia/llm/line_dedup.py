"""Line dedup with DataFrame operations only.

Lines of a text (split at ``\\n``) have a key: the line without ASCII white space at both ends,
A-Z in lower case. A key of at least ``min_chars`` code points found in at least ``min_docs``
documents loses all its lines in every document.

Three shuffles: hashes of the keys of each document to count documents, hashes of frequent keys
back to their documents, and the texts once to meet what they lose. Texts stay in their rows; no
group of lines or documents is ever gathered but the distinct dropped keys of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(line: Column) -> Column:
    key = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(key) == F.char_length(key)  # then lower() changes A-Z alone
    return F.when(plain, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _hash(key: Column) -> Column:
    """128 bits in two independent halves."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def frequent_lines(docs: DataFrame, id_col: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(``id_col``, ``key``): the frequent keys of each document, once each."""
    keys = F.filter(F.transform(_lines(text), _key), lambda k: F.char_length(k) >= min_chars)
    each = (
        docs.select(F.col(id_col).alias("doc"), F.explode(F.transform(F.array_distinct(keys), _hash)).alias("key"))
        .groupBy("key", "doc").agg(F.lit(1).alias("one"))
    )
    often = each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key")
    return each.select("key", "doc").join(often, "key").select(F.col("doc").alias(id_col), "key")


def dedup_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` without frequent lines, with ``n_lines`` (before) and ``n_dropped``.

    Documents are told apart by ``id_col``: rows that share one, null included, count as one
    document, and each of the rows keeps its place in the result with its own text cleaned. A null
    or empty text is one empty line, which ``min_chars`` of 1 never drops; its text stays as it
    was. A text that loses all its lines becomes empty. Other columns pass; ``n_lines`` and
    ``n_dropped`` of the input are replaced. An empty table gives an empty result.
    """
    dropped = (
        frequent_lines(docs, id_col, text, min_docs, min_chars)
        .groupBy(id_col).agg(F.collect_set("key").alias("dropped"))
        .select(F.col(id_col).alias("dropped id"), "dropped")
    )
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rest = [F.col(f"`{c}`") for c in columns if c not in (id_col, text)]  # whatever their names
    given = (F.struct(*rest) if rest else F.lit(0)).alias("row")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), given)
    rows = rows.join(dropped, F.col("id").eqNullSafe(F.col("dropped id")), "left")
    lines = _lines("text")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("dropped"), _hash(_key(x))))
    rows = rows.withColumn("kept", F.when(F.col("dropped").isNotNull(), kept))
    n = F.size(lines).cast("long")
    cleaned = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    return rows.select(
        *({text: cleaned, id_col: F.col("id")}.get(c, F.col("row")[c]).alias(c) for c in columns),
        n.alias("n_lines"),
        F.when(F.col("kept").isNotNull(), n - F.size("kept")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
