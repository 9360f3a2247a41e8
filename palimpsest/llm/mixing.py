"""Mixing to target weights with soft membership.

1. A classifier is trained on the labelled table: one logistic regression on hashed word n-grams
   per domain, all from one bounded sample of the labelled rows (as for quality scores). Domains are
   told by the labels: junk (quality 0), toxic (quality 1, toxic 1) and clean (the rest); any
   other labelled column can be given instead.
2. Every document's posteriors over the domains, which add up to 1, and its tokens are written to
   the shared folder; the text is read once for that.
3. Rates r >= 0 minimise
       sum_k ((sum_d r_d n_d p_dk - T_k) / N)^2  +  ridge * K * sum_d (n_d / N) (r_d - 1)^2
   by projected gradient steps, where n are tokens, p posteriors, T the targets, N all tokens. The
   gradients are averaged in K numbers, so the rates after a step are the projection onto r >= 0 of
   1 - (p . a) / (ridge * K), an expression of the row; a step needs K sums of tokens and K * K sums of
   curvature over the documents above zero, by which the K averages are scaled. Each step is one
   aggregation in the JVM over a few numbers per document; no rates are kept between steps, so a lost
   executor costs its own part of one step. Steps end when the averages are those of the minimum.
4. copies = floor(rate + u), u in [0, 1) a hash of id and text: the expected number is the rate.

Defined results: a null text counts as empty and has no tokens, the posterior of an empty text and
the rate of any document with it; labels that are null are left out; without labels all domains are
equally likely; null ids stay null; repeated rows have the same rates and copies; targets are
normalised to sum 1; a domain that no document can belong to is missed by what it lacks, with a
warning that says by how much; bytes that are not UTF-8 are counted as U+FFFD and stay as they are;
an empty table gives no rows; other columns, whatever their names, pass through mix() as they are.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from palimpsest.llm._base import as_text, cut, frugal, sliced, small_batches, table
from palimpsest.llm._features import scores, sigmoid
from palimpsest.llm._tokens import word_tokens
from palimpsest.llm.quality_classifier import train_all

#: The domains, by the labelled table's columns, and the share of tokens that each shall have.
DOMAINS = {"clean": "quality = 1 and coalesce(toxic, 0) = 0", "junk": "quality = 0", "toxic": "quality = 1 and toxic = 1"}
TARGETS = {"clean": 0.97, "junk": 0.01, "toxic": 0.02}
#: A share of all tokens: a total further from its target is reported.
NEAR = 2e-3


def domain_label(name: str) -> Column:
    return F.when(F.col("quality").isNotNull(), F.coalesce(F.expr(DOMAINS[name]), F.lit(False)).cast("int"))


def posteriors(rows: DataFrame, text: str, models: tuple[np.ndarray, np.ndarray], path: str, n_tokens: str, p: str, keep_text: bool = True) -> DataFrame:
    """rows with n_tokens (as the tokenizer file at `path` counts) and p, the domains' posteriors."""
    w, bias = models
    bits = len(w).bit_length() - 1
    shared = rows.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias))
    at = rows.columns.index(text)
    kept = [c for c in rows.columns if keep_text or c != text]

    def go(batches):
        weights, biases = shared.value
        encoder = word_tokens(path)
        for b in sliced(batches):
            q = sigmoid(scores(b.column(at), weights, biases, bits))
            q /= q.sum(1, keepdims=True)
            n = np.array([encoder.count(as_text(x)) for x in b.column(at)], np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), q.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(rows_at) for rows_at in places), pa.array(n), lists], [*kept, n_tokens, p])

    places = [rows.columns.index(c) for c in kept]
    return rows.mapInArrow(frugal(go, cycles=False), rows.select(*kept).schema.add(n_tokens, "long").add(p, ArrayType(DoubleType())))


def rate(p: Column, averages: np.ndarray, pull: float) -> Column:
    """The rate of a document: the projection of its step from 1 onto what is not negative."""
    dot = F.lit(0.0)
    for k, a in enumerate(averages):
        dot = dot + F.get(p, F.lit(k)) * float(a)
    return F.greatest(F.lit(0.0), 1 - dot / pull)


@dataclass
class Fit:
    """The averages of the gradients, the ridge's pull, what is missed (share of tokens by domain) and the steps taken."""

    averages: np.ndarray
    pull: float
    missed: np.ndarray
    steps: int


def fit_rates(soft: DataFrame, targets: np.ndarray, ridge: float = 1e-4, most: int = 100, enough: float = 1e-9) -> Fit:
    """soft: n_tokens, p. A step that does not bring the averages nearer to the residuals is halved."""
    k, pull = len(targets), ridge * len(targets)
    base = soft.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0

    def look(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, n, p = rate(F.col("p"), a, pull), F.col("n_tokens") / base, lambda j: F.get("p", F.lit(j))
        free = F.when(r > 0, n).otherwise(0.0)
        sums = [F.sum(n * r * p(j)) for j in range(k)] + [F.sum(free * p(i) * p(j)) for i in range(k) for j in range(i, k)]
        out = [float(x or 0) for x in soft.agg(*(x.alias(f"s{m}") for m, x in enumerate(sums))).first()]
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = out[k:]
        return np.array(out[:k]) - targets, m + np.triu(m, 1).T

    a = np.zeros(k)
    if not base:
        return Fit(a, pull, -targets, 0)
    e, m = look(a)
    step, taken = 1.0, 0
    while np.abs(e - a).max() > enough and taken < most and step > 1e-6:
        toward = np.linalg.solve(np.eye(k) + m / pull, e - a)
        new_e, new_m = look(a + step * toward)
        taken += 1
        if np.abs(new_e - (a + step * toward)).max() < np.abs(e - a).max():
            a, e, m, step = a + step * toward, new_e, new_m, min(1.0, 2 * step)
        else:
            step /= 2
    return Fit(a, pull, e, taken)


def _soft(docs: DataFrame, labels: DataFrame, text: str, targets: dict[str, float], label: Callable[[str], Column], names: list[str], path: str, ridge: float, train_on: tuple[DataFrame, str, str], bits: int, keep_text: bool) -> tuple[DataFrame, Fit]:
    goal = np.array([max(0.0, v) for v in targets.values()])
    goal = goal / goal.sum()
    given, id_col, text_col = train_on
    models = train_all(given, labels, [label(name) for name in targets], bits=bits, id_col=id_col, text_col=text_col)
    with small_batches(docs.sparkSession):
        soft = cut(posteriors(docs, text, models, path, *names, keep_text), "posteriors")
    found = fit_rates(soft.select(F.col(names[0]).alias("n_tokens"), F.col(names[1]).alias("p")), goal, ridge)
    if found.steps and np.abs(found.missed).max() > NEAR:
        warnings.warn(f"mixing misses its targets by {dict(zip(targets, found.missed.round(4).tolist()))} of all tokens after {found.steps} steps", stacklevel=3)
    return soft, found


def copies(rate_: Column, *of: Column) -> Column:
    u = F.pmod(F.xxhash64(F.lit(17), *of), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate_ + u).cast("int")


def rates(docs: DataFrame, labels: DataFrame, path: str, targets: dict[str, float] | None = None, label: Callable[[str], Column] = domain_label, id_col: str = "doc_id", text_col: str = "text", ridge: float = 1e-4, bits: int = 18, train_on: DataFrame | None = None) -> DataFrame:
    """id, n_tokens, p (posteriors in the order of the targets), rate, copies; one row per document.
    path: tokenizer file; train_on: the documents that the labels are about, if others than docs."""
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    soft, found = _soft(given, labels, "text", targets or TARGETS, label, ["n_tokens", "p"], path, ridge, (docs if train_on is None else train_on, id_col, text_col), bits, False)
    out = soft.withColumn("rate", rate(F.col("p"), found.averages, found.pull))
    return out.select("id", "n_tokens", "p", "rate", copies(F.col("rate"), F.col("id"), F.col("sig")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, path: str, targets: dict[str, float] | None = None, label: Callable[[str], Column] = domain_label, id_col: str = "doc_id", text_col: str = "text", ridge: float = 1e-4, bits: int = 18, train_on: DataFrame | None = None) -> DataFrame:
    """docs with each row as often as its copies say. Rows keep their place: nothing is shuffled."""
    names = docs.columns
    held = [f"c{k}" for k in range(len(names))]
    i, t = held[names.index(id_col)], held[names.index(text_col)]
    soft, found = _soft(docs.toDF(*held), labels, t, targets or TARGETS, label, ["n_tokens", "p"], path, ridge, (docs if train_on is None else train_on, id_col, text_col), bits, True)
    n = copies(rate(F.col("p"), found.averages, found.pull), F.col(i), F.xxhash64(t))
    times = soft.withColumn("n", n).where("n > 0").select(*held, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return times.select(*held).toDF(*names)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), public_tokenizers.path("word_bpe_49k.json"))
    named = [F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(TARGETS)]
    return out.select(F.col("id").alias("doc_id"), "n_tokens", *named, "rate", "copies")


QUERIES: dict[str, Callable] = {"op10_mixing": op10_mixing}
ORACLE: dict[str, str] = {}
