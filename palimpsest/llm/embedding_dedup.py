"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance D = 2 - 2c. A fixed rotation spreads the
variance, the axes are cut into blocks of `block` dimensions, and each block gets a share of D in
proportion to its dimensions: of two vectors within D, some block's parts lie within its share.

1. Equal vectors become one class with a count, named by the smallest id and told by 128 bits of hash.
2. Each block's space is cut into boxes at medians of a sample, which steers speed alone and grows
   with the number of boxes, PER_BOX for each, up to SAMPLE_BYTES; a class is a member of the box it falls into and a visitor of the later boxes within the
   block's radius. Boxes too full for one task are tiled, so a hot region spreads over tasks.
3. In a tile, members and visitors within the share are candidates; a candidate counts in the
   first block where its parts are within the share, so the union of all blocks has it once. The
   cosine is then taken in double precision from the vectors as given. The tile returns per class
   the number of vectors linked, and its root - never pairs.
4. Sums per class, connected components over the roots, and a join back.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths never link; equal valid vectors always do; repeated ids
keep their rows (the smallest names a component); a null id never names one; an empty table gives
no rows; labels and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.llm._base import cut, frugal, table
from palimpsest.llm._graph import components, settle, unite

SLACK = 1e-9  # of squared distances, far over the rounding of double arithmetic
ROUGH = 1e-5  # the same for single precision, in which pairs are sifted first
#: Sampled vectors for each box, and the bytes of all: 65,536 boxes of 8,192 vectors of 64 dimensions.
PER_BOX, SAMPLE_BYTES = 8, 128 << 20


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, block: int) -> list[slice]:
    n = max(1, round(dim / block))
    edges = np.linspace(0, dim, n + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow of squares
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class Boxes:
    """A block's space, cut at sample medians along the axis of most spread."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.n = 0

        def grow(s: np.ndarray, left: int):
            if left > 0 and len(s) > 1:
                axis = int(np.argmax(s.std(0)))
                at = float(np.median(s[:, axis]))
                if (s[:, axis] > at).any():
                    return [axis, at, grow(s[s[:, axis] <= at], left - 1), grow(s[s[:, axis] > at], left - 1)]
            self.n += 1
            return self.n - 1

        self.root = grow(sample, depth)

    def visit(self, x: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, box and whether it is home, for all boxes within squared distance `within`."""
        out = []

        def go(node, rows, home, gap):
            if not len(rows):
                return
            if isinstance(node, int):
                out.append((rows, np.full(len(rows), node), home))
                return
            axis, at, low, high = node
            d = x[rows, axis] - at
            for child, inside in ((low, d <= 0), (high, d > 0)):
                g = gap
                if not inside.all():  # crossing a face costs its distance, once per axis
                    g = gap.copy()
                    g[~inside, axis] = np.maximum(g[~inside, axis], d[~inside] ** 2)
                k = g.sum(1) <= within
                go(child, rows[k], (home & inside)[k], g[k])

        go(self.root, np.arange(len(x)), np.ones(len(x), bool), np.zeros(x.shape))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def linked(m: np.ndarray, v: np.ndarray, b: int, parts: list[slice], shares: np.ndarray, turn: np.ndarray, cosine: float, step: int = 1 << 19):
    """(member, visitor) index pairs with the cosine, first found in block b."""
    mu, vu = unit(m), unit(v)
    mr, vr = mu @ turn, vu @ turn
    p = parts[b]
    rough, other = np.ascontiguousarray(mr[:, p], np.float32), np.ascontiguousarray(vr[:, p], np.float32)
    mm, vv = np.einsum("ij,ij->i", rough, rough), np.einsum("ij,ij->i", other, other)
    twice = 2 * rough
    many = max(1, step // max(len(m), 1))
    for lo in range(0, len(v), many):
        near = twice @ other[lo : lo + many].T  # |a|^2 + |b|^2 - 2ab <= share
        near -= mm[:, None]
        i_all, j_all = np.nonzero(near >= vv[None, lo : lo + many] - np.float32(shares[b] + ROUGH))
        for at in range(0, len(i_all), 1 << 15):
            i, j = i_all[at : at + (1 << 15)], j_all[at : at + (1 << 15)] + lo
            for e in [b, *range(b)]:  # within this block's share, and in no earlier one's: near copies leave at the first
                gap = mr[i, parts[e]] - vr[j, parts[e]]
                close = np.einsum("ij,ij->i", gap, gap) <= shares[e] + SLACK
                k = close if e == b else ~close
                i, j = i[k], j[k]
                if not len(i):
                    break
            k = np.einsum("ij,ij->i", mu[i], vu[j]) >= cosine
            if k.any():
                yield i[k], j[k]


def drawn(classes: DataFrame, total: int, boxes: int, dim: int) -> np.ndarray:
    """Vectors for the boxes' medians: about PER_BOX for each box, 4096 at least, told by a hash of the class."""
    rows = min(max(4096, PER_BOX * boxes), SAMPLE_BYTES // (8 * dim))
    part = 1 << 20
    some = classes if rows >= total else classes.where(F.pmod(F.xxhash64(F.lit(5), "cid"), F.lit(part)) < int(np.ceil(rows / total * part)))
    t = some.select("v").toArrow().combine_chunks()
    return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if t.num_rows else np.zeros((0, dim))


def near_classes(classes: DataFrame, dim: int, cosine: float, block: int = 8, box: int = 8192) -> DataFrame:
    """(cid, n, root): for tiles, vectors linked to a class and its smallest class there. classes: cid, n, v."""
    spark = classes.sparkSession
    total = classes.count()
    depth = max(0, int(np.ceil(np.log2(max(total, 1) / box))))
    parts, turn = blocks(dim, block), rotation(dim)
    share = (2 - 2 * cosine) * np.array([(p.stop - p.start) / dim for p in parts])
    some = drawn(classes, total, 1 << depth, dim) if depth else np.zeros((0, dim))
    some = unit(some) @ turn if len(some) else some
    shared = spark.sparkContext.broadcast([Boxes(some[:, p], depth) for p in parts])

    def matrix(column, n: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            turned = unit(matrix(b.column(2), b.num_rows)) @ turn
            for k, boxes in enumerate(shared.value):
                row, at, home = boxes.visit(turned[:, parts[k]], share[k] + 2 * SLACK)
                first = np.full(b.num_rows, -1)
                first[row[home]] = at[home]
                keep = at >= first[row]
                row, at, home = row[keep], at[keep], home[keep]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.full(len(row), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(home)], ["cid", "block", "box", "home"])

    routed = cut(classes.mapInArrow(frugal(route), "cid long, block int, box int, home boolean"), "boxes")
    sizes = routed.groupBy("block", "box").agg(F.count_if("home").alias("m"), F.count("*").alias("r")).where("m > 0")
    tiles = sizes.select("block", "box", F.ceil(F.col("m") / (2 * box)).cast("int").alias("across"), F.ceil(F.col("r") / (4 * box)).cast("int").alias("down"))
    sent = routed.join(tiles, ["block", "box"])
    slot = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    keys = ["cid", "block", "box", "home"]
    as_member = sent.where("home").select(*keys, F.lit(True).alias("member"), slot("across").alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    as_visitor = sent.select(*keys, F.lit(False).alias("member"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), slot("down").alias("y"))

    def tile(key, t):
        t = t.combine_chunks()
        cid, n = t["cid"].to_numpy(), t["n"].to_numpy()
        is_m, home = t["member"].to_numpy(), t["home"].to_numpy()
        v = matrix(t["v"].chunk(0) if t["v"].num_chunks else t["v"], len(cid))
        m, w = np.flatnonzero(is_m), np.flatnonzero(~is_m)
        names, at = np.unique(cid, return_inverse=True)
        parent, count = np.arange(len(names)), np.zeros(len(names), np.int64)
        for i, j in linked(v[m], v[w], key[0].as_py(), parts, share, turn, cosine):
            i, j = m[i], w[j]
            keep = ~home[j] | (cid[i] < cid[j])  # pairs of members come both ways round
            i, j = i[keep], j[keep]
            np.add.at(count, at[i], n[j])
            np.add.at(count, at[j], n[i])
            parent = unite(parent, at[i], at[j])
        parent = settle(parent)
        k = np.flatnonzero(count)
        return pa.table({"cid": names[k], "n": count[k], "root": names[parent[k]]})

    filled = as_member.unionByName(as_visitor).join(classes, "cid").select("block", "box", "x", "y", "cid", "n", "v", "member", "home")
    return filled.groupBy("block", "box", "x", "y").applyInArrow(tile, "cid long, n long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, block: int = 8, box: int = 8192) -> DataFrame:
    """id, n_links, component_id, kept; one row per vector."""
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"  # floats stay what they are
    # -0.0 + 0.0 is 0.0: vectors that are equal as numbers are one class
    v = F.transform(F.col(vec_col), lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = vectors.select(F.col(id_col).alias("id"), F.when(sound, v).alias("v"))
    rows = cut(given.select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")), "vectors")
    good = rows.where("v is not null")
    stand_in = lambda lo, bits: F.lit(-(1 << lo)) + F.pmod(F.col("a"), F.lit(1 << bits))
    classes = good.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").cast("long").alias("named"), F.first("v").alias("v"))
    classes = cut(classes.select("a", "b", "n", "named", "v", F.coalesce("named", stand_in(62, 61)).alias("cid"), F.size("v").alias("size")), "classes")
    if classes.groupBy("cid").count().where("count > 1").limit(1).count():  # repeated ids name two classes: each needs its own
        alone = F.count("*").over(Window.partitionBy("cid")) == 1
        classes = cut(classes.withColumn("cid", F.when(alone, F.col("cid")).otherwise(stand_in(61, 60))), "classes")
    parts = []
    for r in classes.select("size").distinct().orderBy("size").toLocalIterator():  # one join for each length of vector
        own = classes.where(F.col("size") == r["size"]).select("cid", "n", "v")
        parts.append(cut(near_classes(own, r["size"], cosine, block, box), "linked"))
    own = F.col("id").cast("long")
    told = lambda df, links, least: df.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("id") == least, F.lit(False)).alias("kept"))
    alone = told(rows.where("v is null"), F.lit(0), own)
    if not parts:
        return alone
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    counts = found.groupBy(F.col("cid").alias("c")).agg(F.sum("n").alias("links"))
    roots = components(found.where("cid != root"), "cid", "root")
    named = classes.drop("v").join(counts, F.col("cid") == F.col("c"), "left").join(roots, F.col("cid") == F.col("node"), "left")
    named = named.select("a", "b", "named", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("named").alias("least"))
    named = named.join(least, "root").select("a", "b", "n_links", "least")
    return told(good.select("id", "a", "b").join(named, ["a", "b"]), F.col("n_links"), F.coalesce("least", own)).unionByName(alone)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of distinct vectors, and components by reachability.
SQL = """
WITH RECURSIVE given AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sound AS (
  SELECT vec_id, v FROM given
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM given
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT l.x AS vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, l.x = l.component_id AS kept
FROM least l LEFT JOIN counted c ON c.x = l.x
"""
QUERIES: dict[str, Callable] = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLE: dict[str, str] = {"op1_embedding_dedup": SQL}
