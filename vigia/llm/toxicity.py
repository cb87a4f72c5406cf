"""Toxicity by compression distance.

Two dictionaries are trained by zstandard on words of labelled text, one on toxic and one on
ordinary documents. A window is a single word: in longer ones the few bytes that an insult saves
drown in how the rest happens to be parsed. Each word is a training sample as often as documents
of the class hold it, in the toxic class also its beginning, as insults are inflected; from the
samples of the toxic class go those that ordinary text explains, so that the frequent words of any
text do not fill its dictionary. It serves behind the ordinary one, so that it can only add to
what ordinary text explains of a window. Every window of a text is then
compressed with both; its margin is the ordinary length minus the toxic one, divided by the
window's bytes.

Dictionaries serve as content: their entropy tables, of text that is mostly alike in both, would
cost the few bytes that tell them apart. A window is compressed between fixed bytes. Both
dictionaries end with those before it, so that zstandard never falls back to storing it, and those
after it let a match begin late in the window.

The margin above which a window counts, and the weights of the number of such windows and of all
windows, are calibrated by logistic regression on labelled documents that did not train the
dictionaries.

Training reads at most ``Settings.toxic_docs`` and ``ordinary_docs`` labelled documents, those of
the smallest hash; scoring reads every byte of every text.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.operators.paging import first_rows

from .common import Batches, cut, extend, importable, kept, sliced, texts, with_columns

WORD = re.compile(rb"[a-z\x80-\xff]{1,48}")
HEADS = (6, 7, 8)
BEFORE, AFTER = b"zstd windows follow this text: ", b"0123456789"
COMPRESSION = dict(
    window_log=17, hash_log=14, chain_log=15, search_log=5, min_match=4, target_length=64,
    strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False,
    write_dict_id=False,
)
MARGINS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55)
REMEMBERED = 300_000


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample that trains a model, and of what it keeps."""

    toxic_docs: int = 4_000
    ordinary_docs: int = 8_000
    calibration_part: int = 3  # one in so many sampled documents calibrates
    errors: float = 1.5  # standard errors that a count of toxic documents must be above the expected one
    words: int = 50_000  # different segments that train a dictionary, the most frequent
    samples: int = 500_000  # training samples of a dictionary, about
    toxic_bytes: int = 8_192
    ordinary_bytes: int = 112_640
    segment: int = 24  # of the trainer: bytes chosen at a time, and bytes counted
    counted: int = 6


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    margin: float
    bias: float
    weight: float
    length_weight: float


def windows(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def segments(words: set[bytes]) -> set[bytes]:
    """Whole words with the spaces around them, and the beginnings of longer ones."""
    out = set()
    for w in words:
        w = b" " + w + b" "
        out.add(w)
        out.update(w[:k] for k in HEADS if k < len(w))
    return out


class Margins(dict):
    """Window to margin; forgets everything when it has become large."""

    def __init__(self, model: Model):
        super().__init__()
        settings = zstandard.ZstdCompressionParameters(**COMPRESSION)
        pair = []
        for content in (model.toxic, model.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            pair.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=d).compress)
        self.toxic, self.ordinary = pair

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        w = BEFORE + b" " + word + b" " + AFTER
        margin = self[word] = (len(self.ordinary(w)) - len(self.toxic(w))) / (len(word) + 2)
        return margin


def hits(text: bytes, margins: Margins) -> list[int]:
    """Windows, and those of at least each margin of MARGINS."""
    words = windows(text)
    found = [m for m in map(margins.__getitem__, words) if m >= MARGINS[0]]
    return [len(words), *(sum(m >= least for m in found) for least in MARGINS)]


def _labelled(labels: DataFrame, s: Settings) -> DataFrame:
    """A bounded sample of the training labels, in two parts."""
    ids = F.col("doc_id").cast("string")
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .where(F.crc32(ids) % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("hash", F.xxhash64("doc_id"))
    )

    def some(label: int, n: int) -> DataFrame:
        return first_rows(rows.where(F.col("toxic") == label), n, [F.col("hash"), F.col("doc_id")])

    sample = some(1, s.toxic_docs).unionByName(some(0, s.ordinary_docs))
    return sample.withColumn("calibrates", F.pmod("hash", F.lit(s.calibration_part)) == 0)


def _sketches(batches: Batches) -> Batches:
    """Adds a minimum over five-word shingles: near copies mostly share it."""
    for batch in sliced(batches):
        out = []
        for t in texts(batch.column("text")):
            w = windows(t)
            out.append(min((xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) >> 1 for i in range(max(1, len(w) - 4))), default=0))
        yield extend(batch, {"sketch": pa.array(out, pa.int64())})


def _segment_counts(batches: Batches) -> Batches:
    """Documents with each segment, by class, added up for as many rows as memory allows."""
    for batch in sliced(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for t, y in zip(texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            counts[y].update(segments(set(windows(t))))
        for y in (0, 1):
            keys, n, zero = list(counts[y]), list(counts[y].values()), [0] * len(counts[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(n if y else zero, pa.int64()), pa.array(zero if y else n, pa.int64())],
                names=["segment", "a", "b"],
            )


def _dictionary(rows: list, size: int, s: Settings) -> bytes:
    """A dictionary that zstandard trains on segments, each as often as its ``n`` says.

    Samples too few to train on are the dictionary themselves, the most frequent last.
    """
    found = sorted((r["n"], bytes(r["segment"])) for r in rows)
    share = min(1.0, s.samples / max(1, sum(n for n, _ in found)))
    samples = [x for n, x in found for _ in range(math.ceil(n * share))]
    random.Random(0).shuffle(samples)  # the trainer takes its segments from all parts of them alike
    try:
        content = zstandard.train_dictionary(size, samples, k=s.segment, d=s.counted).as_bytes()
    except zstandard.ZstdError:
        content = b"".join(x for _, x in found)[-size:]
    return content


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """A model from the labelled documents whose crc32 of the id leaves a remainder by 5.

    Without labels of both classes the model has empty dictionaries and scores every text alike.
    """
    spark = docs.sparkSession
    importable(spark)
    sample = F.broadcast(_labelled(labels, s))  # at most toxic_docs + ordinary_docs rows
    rows = docs.select("doc_id", "text").join(sample, "doc_id")
    schema = with_columns(rows.schema, T.StructField("sketch", T.LongType()))
    one = F.min_by(F.struct("doc_id", "text", "toxic", "calibrates"), F.struct("doc_id", "text"))
    rows = cut(
        rows.mapInArrow(_sketches, schema).groupBy("sketch").agg(one.alias("row")).select("row.*"),
        "toxicity-sample",
    )
    sizes = {r["toxic"]: r["n"] for r in rows.where("not calibrates").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    prior = (n + 1) / (n + m + 2)
    if not n or not m:
        return Model(BEFORE, BEFORE, MARGINS[0], math.log(prior / (1 - prior)), 0.0, 0.0)
    counts = cut(
        rows.where("not calibrates").select("text", "toxic")
        .mapInArrow(_segment_counts, "segment binary, a long, b long")
        .groupBy("segment").agg(F.sum("a").alias("a"), F.sum("b").alias("b")),
        "toxicity-segments",
    )
    expected = F.col("b") * n / m
    excess = F.floor(F.col("a") - expected - s.errors * (F.sqrt("a") + F.sqrt(expected)))

    word = F.expr("right(hex(segment), 2) = '20'")

    def most(count: Column) -> list:
        return counts.select("segment", count.alias("n")).where("n > 0").orderBy(F.desc("n"), "segment").limit(s.words).collect()

    toxic, ordinary = most(excess), most(F.when(word & (F.col("b") > 1), F.col("b")))
    plain = _dictionary(ordinary, s.ordinary_bytes, s)
    model = Model(plain + _dictionary(toxic, s.toxic_bytes, s) + BEFORE, plain + BEFORE, MARGINS[0], 0.0, 0.0, 0.0)
    return _calibrated(rows.where("calibrates"), model, prior)


def _calibrated(rows: DataFrame, model: Model, prior: float) -> Model:
    def count(batches: Batches) -> Batches:
        margins = Margins(model)
        for batch in sliced(batches):
            found = [hits(t, margins) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "hits"]
            )

    sample = rows.select(F.col("toxic").cast("int").alias("toxic"), "text")
    got = sample.mapInArrow(count, "toxic int, hits array<int>").collect()
    y = np.array([r["toxic"] for r in got], float)
    found = np.log1p(np.array([r["hits"] for r in got], float).reshape(len(got), 1 + len(MARGINS)))
    best = (math.inf, MARGINS[0], math.log(prior / (1 - prior)), 0.0, 0.0)
    for k, margin in enumerate(MARGINS, 1):
        loss, weights = _logistic(found[:, k], found[:, 0], y, prior)
        best = min(best, (loss, margin, *weights))
    return Model(model.toxic, model.ordinary, *best[1:])


def _logistic(hits: np.ndarray, length: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, list[float]]:
    """Loss and weights (bias, hits, length) of a logistic regression by Newton steps, lightly held to 0.

    Hits never speak for an ordinary text, nor does length for a toxic one.
    """
    X = np.column_stack([np.ones_like(hits), hits, length])
    w = np.array([math.log(prior / (1 - prior)), 0.0, 0.0])
    start = w.copy()
    hold = np.diag([0.05, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + hold, X.T @ (y - p) - hold @ (w - start))
        w = w + np.clip(step, -2, 2)
        w[1], w[2] = max(w[1], 0.0), min(w[2], 0.0)
    p = np.clip(1 / (1 + np.exp(-np.clip(X @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), w.tolist()


def _margins(model: Model) -> Margins:
    key = zlib.crc32(model.toxic) << 32 | zlib.crc32(model.ordinary)
    return kept("margins", key, lambda: Margins(model))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (0 or 1), ``n_windows``, ``n_hits``.

    A row in, a row out, whatever else the table holds: repeated rows are scored alike, other
    columns pass. Null and empty texts have no window and get the score of a text without hits. An
    input column of one of the four names is replaced. An empty table gives an empty result.
    """
    importable(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        margins = _margins(model)
        for batch in sliced(batches):
            total, found = [], []
            for t in texts(batch.column(text)):
                words = windows(t)
                total.append(len(words))
                found.append(sum(m >= model.margin for m in map(margins.__getitem__, words)))
            counted = np.log1p(np.array([found, total], float))
            p = 1 / (1 + np.exp(-np.clip(model.bias + model.weight * counted[0] + model.length_weight * counted[1], -30, 30)))
            yield extend(batch, {
                "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32)),
                "n_windows": pa.array(total, pa.int64()), "n_hits": pa.array(found, pa.int64()),
            })

    new = [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("n_windows", T.LongType()), T.StructField("n_hits", T.LongType()),
    ]
    return docs.mapInArrow(run, with_columns(docs.schema, *new))
