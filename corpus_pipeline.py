"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, toxicity
from vigia.llm.common import cut, table
from vigia.llm.queries import BYTE_RANKS

#: What ``run`` returns cannot be expressed in SQL: the first stage compares compressed lengths.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all else in one column, so that no name of it meets an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias("given"))


def unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, from rows that were ``packed``."""
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col("given")[c].alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of what it is given.

    Null and empty texts have no toxic words and stay, as do rows with a null or repeated id, which
    are judged by their own text. Other columns pass, whatever their names; no rows give none.
    """
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), model).where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go; ``n_chars``, where there is one, follows the text.

    Rows that share an id, null too, count as one document. A null or empty text stays as it is, a
    text that loses all its lines becomes empty. Other columns pass, whatever their names; no rows
    give none.
    """
    out = unpacked(line_dedup.dedup_lines(packed(docs), min_docs=10, min_chars=1), docs)
    chars = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns(chars)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one of the smallest id stays.

    A document is a row: rows of one id with different texts are told apart, repeated rows are
    copies of which one stays, and a row without an id stays only where none of its group has one.
    Rows without words link with nothing and stay. Other columns pass, whatever their names.
    """
    rows = cut(packed(docs).withColumn("near_row", F.monotonically_increasing_id()), "near-copy-rows")
    texts = rows.select(F.col("near_row").alias("doc_id"), "text")
    groups = jaccard_join.jaccard_components(texts, size=5, num=8, den=10)
    groups = groups.select(F.col("doc_id").alias("near_row"), F.col("component_id").alias("component"))
    grouped = cut(groups.join(rows.select("near_row", "doc_id"), "near_row"), "near-copy-groups")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("near_row"))
    first = grouped.groupBy("component").agg(F.min_by("near_row", order).alias("stays"), F.count("*").alias("n")).where("n > 1")
    # written, so that its size is known: up to Spark's limit it is broadcast, and no text is shuffled
    others = cut(grouped.join(first, "component").where("near_row <> stays").select("near_row"), "near-copy-others")
    return unpacked(rows.join(others, "near_row", "left_anti"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows are judged by their own text: null and empty ones hold nothing and stay, whatever their
    ids. Other columns pass, whatever their names; no rows, or no benchmark, take nothing away.
    """
    found = decontaminate.find_benchmark(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(found.where(F.size("hits") == 0), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and whether decoding gives the text back.

    One row for each row; a null text is an empty one. ``lang`` and ``source`` pass, null where the
    documents lack them.
    """
    path = public_tokenizers.path(BYTE_RANKS)
    named = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    coded = byte_bpe.encode(docs.select("doc_id", "text", *named), path, public_tokenizers.PATTERN, decoded=True)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return coded.select(
        "doc_id", "lang", "source", "n_tokens", F.col("ids"), (F.col("decoded") == text).alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERY = {"pipeline": run}
