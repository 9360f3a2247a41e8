"""Connected components: in one task over arrays, and over all executors for edges of any number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm._base import cut


def settle(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins a[i] with b[i]; every root is the smallest index of its component."""
    while True:
        parent = settle(parent)
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return parent
        ra, rb = ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node long, component long): for each node of an edge the smallest node that it reaches.

    Alternates large-star and small-star until an iteration changes nothing. Each half groups by
    a node only to take a minimum, which combines before the shuffle, and joins that minimum
    back, a join whose hot keys adaptive execution splits; no group is ever gathered. Each
    iteration is cut into the shared folder. Edges with a null end are ignored; no edges, no rows.
    """
    now = cut(
        edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"))
        .where(f"{a} is not null and {b} is not null and {a} != {b}").distinct(), "edges"
    )

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        return r["n"], r["h"]

    seen = mark(now)
    while seen[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi != lo").distinct()
        # large-star has each edge once, from the larger end: small-star groups by that end
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("v"), F.col("m").alias("u"))
        small = small.unionByName(low.select(F.col("hi").alias("v"), F.col("m").alias("u")))
        now = cut(small.where("u != v").select("u", "v").distinct(), "edges")
        then, seen = seen, mark(now)
        if then == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
