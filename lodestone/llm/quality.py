"""Compression classifier: how much better does good text explain a document than bad text?

Two zstandard dictionaries are trained on good and two on bad labelled documents, one
of each pair on the texts and one on their shapes (letters, capitals, digits and
runs folded together).  A document's compressed sizes under them, as normalised
differences of bad and good and as shares of what is compressed, are all that a logistic curve
weighs, which is fitted on labelled documents that no dictionary has seen.  The whole
text is always compressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.workspace import fresh

#: At most so many labelled documents of each class are fitted on, none longer than so many bytes.
TRAIN_PER_CLASS, TRAIN_BYTES = 3000, 32_768
DICTIONARY_BYTES, LEVEL = 112 << 10, 3

_FOLD = bytes(97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 122 if c >= 128 else c for c in range(256))
_RUN = re.compile(rb"([aAz0])\1+")


def shape(text: bytes) -> bytes:
    return _RUN.sub(rb"\1", text.translate(_FOLD))


@dataclass
class Model:
    """Dictionaries as bytes (good and bad text, good and bad shape) and the curve's weights.

    Without both classes to learn from there are no dictionaries and every score is ``prior``.
    """

    prior: float
    dictionaries: tuple[bytes, ...] = ()
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for d in self.dictionaries:
            known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)
            known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known))
        return out

    def scores(self, texts: list[bytes], compressors: list) -> np.ndarray:
        if not self.dictionaries:
            return np.full(len(texts), self.prior)
        z = _design((features(texts, compressors) - self.mean) / self.spread)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def features(texts: list[bytes], compressors: list) -> np.ndarray:
    """Per text, of compressed sizes only: the normalised differences of bad and good, for the text and its shape, and both shares."""
    out = np.zeros((len(texts), 4))
    good, bad, good_shape, bad_shape = compressors
    for k, text in enumerate(texts):
        folded = shape(text)
        g, b, gs, bs = len(good.compress(text)), len(bad.compress(text)), len(good_shape.compress(folded)), len(bad_shape.compress(folded))
        out[k] = (b - g) / (b + g), (bs - gs) / (bs + gs), g / (len(text) + 1), gs / (len(folded) + 1)
    return out


def _design(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -6, 6)
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i + 1)]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton steps, halved while the penalised likelihood would fall."""
    w, keep = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]

    def loss(v: np.ndarray) -> float:
        m = x @ v
        return float(np.sum(np.logaddexp(0, m) - y * m) + 0.5 * np.sum(keep * v * v))

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), x.T @ (y - p) - keep * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        now, before = loss(w), now
        if before - now < 1e-7:
            break
    return w


def fit(good: list[bytes], bad: list[bytes]) -> Model:
    """Half of each class makes the dictionaries, the other half the curve."""
    if len(good) < 4 or len(bad) < 4:
        return Model(prior=(len(good) + 1) / (len(good) + len(bad) + 2))

    def trained(texts: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
        except zstandard.ZstdError:  # too few or too small samples to train on: the samples themselves
            # a raw dictionary must not begin with the magic number of a trained one
            return b"\n" + b"\n".join(texts)[-DICTIONARY_BYTES:]

    halves = [(t[: len(t) // 2], t[len(t) // 2 :]) for t in (good, bad)]
    sources = [trained(first) for first, _ in halves] + [trained([shape(t) for t in first]) for first, _ in halves]
    model = Model(prior=0.5, dictionaries=tuple(sources))
    x = features([*halves[0][1], *halves[1][1]], model.compressors())
    y = np.r_[np.ones(len(halves[0][1])), np.zeros(len(halves[1][1]))]
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic(_design((x - model.mean) / model.spread), y)
    return model


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fits on a bounded sample: the ``per_class`` labelled ids of each class that come first by hash.

    Held-out rows are left out.  An id with conflicting labels, or a null one, counts as unlabelled.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(-1))).alias("quality"), F.max("quality").alias("other")).where("quality = other")
        .withColumn("turn", F.xxhash64("doc_id"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).where(F.length("text") <= most_bytes)
    ids = [known.where(F.col("quality") == label).orderBy("turn", "doc_id").limit(per_class).select("doc_id", "turn", "quality") for label in (1, 0)]
    # at most per_class rows of each class on one side, so the broadcast has a fixed bound
    # an id of several rows is learnt once, from the text that comes first by hash
    one = F.min(F.struct(F.md5("text").alias("hash"), "text")).alias("x")
    rows = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("quality", "turn", "doc_id").agg(one)
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.orderBy("quality", "turn", "doc_id").select("quality", "x.text").collect():
        found[r["quality"]].append(bytes(r["text"]))
    return fit(found[1], found[0])


def add_score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text; a null text scores as an empty one."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = model.compressors()
        for batch in batches:
            out = [model.scores([(t or "").encode() for t in batch.slice(at, 256).to_pylist()], compressors) for at in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(name, score(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """Scores every document: doc_id, held_out, score, predicted.

    Defined results: null texts score as empty ones; a null doc_id is scored and not held
    out; repeated rows are scored alike; with too few labels of either class every
    score is the same prior; an empty table gives no rows; other columns, labels among
    them, are never read.
    """
    model = train(docs, labels, per_class)
    scored = add_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """The documents that the classifier does not reject, with their columns as they came."""
    name = fresh(docs, "quality_score")
    return add_score(docs, train(docs, labels, per_class), name).where(F.col(name) >= 0.5).drop(name)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels)


QUERIES = {"op7_quality": op7_quality}
ORACLE_SQL: dict[str, str] = {}
