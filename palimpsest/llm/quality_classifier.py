"""Quality scores by a logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and applied as sparse dot products.

Training sees a bounded sample of the labelled rows: the `sample` documents of least hash among
those that may be learnt from, each by at most its first `TEXT_CHARS` characters, and of them, in
that order, at most `sample_bytes` of text. One
task trains on it and returns the weights that are not zero, at most 2**bits. Scoring covers every
row and whole texts, reads nothing but the text, and shuffles nothing.

Defined results: a null text counts as empty, whose score is the model's bias; bytes that are not
UTF-8 are letters, as all beyond ASCII; labels that are null are left out, several labels of one document count as their majority (0 on a tie); without labels
every score is 0.5; repeated rows each get their score; null ids stay null and count as held out;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.llm._base import frugal, release, table
from palimpsest.llm._features import fit, scores, sigmoid

FOLDS, THRESHOLD = 5, 0.3
#: One labelled text's share of the sample, which no text can so fill alone.
TEXT_CHARS = 1 << 18


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, label: list[Column], rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `rows` labelled documents that may be learnt from: y (array, -1 where no label is known), text and a place in an order by hash."""
    names = [f"y{k}" for k in range(len(label))]
    known = labels.select(F.col(id_col).alias("i"), *(y.alias(k) for k, y in zip(names, label)))
    one = (
        known.where("i is not null").where(F.coalesce(*names).isNotNull()).where(fold("i") != 0)
        .groupBy("i").agg(F.array(*(F.coalesce((F.avg(k) > 0.5).cast("int"), F.lit(-1)) for k in names)).alias("y"))
        .orderBy(F.xxhash64("i"), "i").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("j"), F.left(F.col(text_col), F.lit(TEXT_CHARS)).alias("text"))
    return F.broadcast(one).join(texts, F.col("i") == F.col("j")).select("y", "text", F.xxhash64("i").alias("at"))


def first_bytes(batches, most: int) -> pa.Table:
    """y and text of the rows of least `at`, as many as `most` bytes of text allow, in the order of
    `at`. No more than a batch and a text beyond that is held at any time: the first text that does not
    fit is kept till the end, so that none after it enters with a later batch."""
    held: pa.Table | None = None
    room = 0
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        held = held.sort_by([("at", "ascending"), ("text", "ascending")])
        size = np.cumsum(pc.fill_null(pc.binary_length(held["text"]), 0).to_numpy(), dtype=np.int64)
        room = int(np.searchsorted(size, most, "right"))
        held = held.slice(0, room + 1).combine_chunks()
    return held.slice(0, room) if held is not None else pa.table({"y": pa.array([], pa.list_(pa.int32())), "text": pa.array([], pa.string()), "at": pa.array([], pa.int64())})


def train_all(docs: DataFrame, labels: DataFrame, label: list[Column], bits: int = 18, rows: int = 8192, sample_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Weights of 2**bits slots, a column for each label, and the biases, from one reading of the documents."""
    m = len(label)

    def go(batches):
        t = first_bytes(batches, sample_bytes)
        release()
        if t.num_rows:
            w, bias = fit(t["text"].combine_chunks(), np.array(t["y"].to_pylist(), np.int64).reshape(-1, m), bits)
            for k in range(m):
                at = np.flatnonzero(w[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1)), pa.array(np.append(w[at, k], bias[k]))], ["label", "slot", "w"])

    chosen = sample(docs, labels, label, rows, id_col, text_col)
    w, bias = np.zeros((1 << bits, m)), np.zeros(m)
    t = chosen.repartition(1).mapInArrow(frugal(go), "label int, slot long, w double").toArrow()
    k, slot, value = (t[c].to_numpy() for c in ("label", "slot", "w"))
    w[slot[slot >= 0], k[slot >= 0]] = value[slot >= 0]
    bias[k[slot < 0]] = value[slot < 0]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, label: Column | None = None, **how) -> tuple[np.ndarray, float]:
    """Weights of 2**bits slots, and the bias."""
    w, bias = train_all(docs, labels, [F.col("quality") if label is None else label], **how)
    return w[:, 0], float(bias[0])


def _scorer(docs: DataFrame, model: tuple[np.ndarray, float]) -> Callable:
    bits = int(len(model[0])).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def score_of(texts: pa.Array) -> np.ndarray:
        w, bias = shared.value
        return sigmoid(scores(texts, w.reshape(-1, 1), [bias], bits)[:, 0])

    return score_of


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted."""
    score_of = _scorer(docs, model)

    def go(batches):
        for b in batches:
            s = score_of(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["c0", "score", "predicted"])

    given = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1"))
    out = given.mapInArrow(frugal(go), f"c0 {dict(docs.dtypes)[id_col]}, score double, predicted int")
    return out.select(F.col("c0").alias(id_col), F.coalesce(fold("c0") == 0, F.lit(True)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns, whatever their names."""
    score_of, at, names = _scorer(docs, model), docs.columns.index(text_col), docs.columns
    given = docs.toDF(*(f"c{k}" for k in range(len(names))))

    def go(batches):
        for b in batches:
            yield b.filter(pa.array(score_of(b.column(at)) >= threshold))

    return given.mapInArrow(frugal(go), given.schema).toDF(*names)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable] = {"op6_quality_classifier": op6_quality_classifier}
ORACLE: dict[str, str] = {}
