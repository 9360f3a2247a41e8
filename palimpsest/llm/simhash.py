"""SimHash near-duplicates by vantage-point trees.

1. One fingerprint per text: XXH64 (seed 42) of its word shingles; a bit is set if it is in over
   half of them. Equal fingerprints become one class, named by its smallest id.
2. A vantage-point tree halves the classes by Hamming distance from vantage points of a sample
   until a shard holds about `shard` of them. The sample steers speed alone; it grows with the number
   of shards, PER_SHARD fingerprints for each, up to SAMPLE (32 MB, half a million shards).
3. A class is a member of the shard it falls into and a visitor of the later shards that its ball
   of radius `most` overlaps: by the triangle inequality it goes inside a vantage point's radius m
   if d <= m + most, and outside if d > m - most. Each linked pair so meets once, in the later
   one's shard. Shards too large for a task are tiled.
4. In a tile a tree of the same kind finds all pairs within `most` bits exactly. The tile returns
   its members' and visitors' roots - as many rows as it has linked classes, never pairs.
5. Connected components over those, and a join back by fingerprint.

Defined results: a text without words, null or empty, has fingerprint zero and links like any
other; fewer words than a shingle count as one shingle; rows repeated or with a null id keep their
row, the smallest id that is not null names a component (null if all are); an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm._base import cut, frugal, table
from palimpsest.llm._copies import near_copies
from palimpsest.llm._graph import components, settle, unite


def fingerprint(text: str | None, shingle: int = 4) -> int:
    import xxhash

    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return 0
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(at) + 1
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    start, end = [0, *(at[: n - shingle] + 1).tolist()], [*at[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_digest
    h = b"".join([digest(joined[s:e], 42) for s, e in zip(start, end)])
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(h), 8 << 14):  # a very long text by and by
        part = np.frombuffer(h, np.uint8)[lo : lo + (8 << 14)].reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h) // 8).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id and fp, the fingerprint as a signed long."""

    def go(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(frugal(go), f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """The upper part of a vantage-point tree: [point, radius, inside, outside] or a shard's number."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 11):
        order, self.shards = np.random.default_rng(seed), 0

        def grow(s: np.ndarray, left: int):
            if left > 0 and len(s) > 1:
                point = s[order.integers(len(s))]
                d = distance(s, point)
                radius = int(np.median(d))
                if radius < d.max():
                    return [point, radius, grow(s[d <= radius], left - 1), grow(s[d > radius], left - 1)]
            self.shards += 1
            return self.shards - 1

        self.root = grow(sample, depth)

    def visit(self, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, shard and whether it is the row's home, for all shards its ball overlaps."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def go(node, rows: np.ndarray, home: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, int):
                out.append((rows, np.full(len(rows), node), home))
                return
            point, radius, inside, outside = node
            d = distance(fps[rows], point)
            go(inside, rows[k := d <= radius + most], (home & (d <= radius))[k])
            go(outside, rows[k := d > radius - most], (home & (d > radius))[k])

        go(self.root, np.arange(len(fps)), np.ones(len(fps), bool))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(bool)
        return tuple(np.concatenate(x) for x in zip(*out))


def near_pairs(members: np.ndarray, visitors: np.ndarray, most: int, leaf: int = 96, seed: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (member, visitor) index pairs within `most` bits, each once, by a tree over the members."""
    order = np.random.default_rng(seed)
    todo = [(np.arange(len(members)), np.arange(len(visitors)))]
    while todo:
        m, v = todo.pop()
        if not len(m) or not len(v):
            continue
        if len(m) > leaf:
            point = members[m[order.integers(len(m))]]
            dm, dv = distance(members[m], point), distance(visitors[v], point)
            radius = int(np.median(dm))
            if radius < dm.max():
                todo.append((m[dm <= radius], v[dv <= radius + most]))
                todo.append((m[dm > radius], v[dv > radius - most]))
                continue
        step = max(1, (1 << 18) // len(m))
        for lo in range(0, len(v), step):
            i, j = np.nonzero(np.bitwise_count(members[m][:, None] ^ visitors[v[lo : lo + step]][None]) <= most)
            if len(i):
                yield m[i], v[lo + j]


PER_SHARD, SAMPLE = 8, 1 << 22


def drawn(classes: DataFrame, total: int, shards: int) -> np.ndarray:
    """Fingerprints to take vantage points and radii from: about PER_SHARD for each shard, 4096 at least, told by their hash."""
    rows = min(max(4096, PER_SHARD * shards), SAMPLE)
    part = 1 << 20
    some = classes if rows >= total else classes.where(F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(part)) < int(np.ceil(rows / total * part)))
    return np.sort(some.select("fp").toArrow()["fp"].to_numpy()).view(np.uint64)


def near_classes(classes: DataFrame, most: int, shard: int = 8192) -> DataFrame:
    """(a, b): edges that connect the classes (fp, first) as all pairs within `most` bits do."""
    spark = classes.sparkSession
    n = classes.count()
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / shard))))
    tree = spark.sparkContext.broadcast(Tree(drawn(classes, n, 1 << depth) if depth else np.zeros(0, np.uint64), depth))

    def route(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            row, at, home = tree.value.visit(fp.view(np.uint64), most)
            first = np.full(len(fp), -1)
            first[row[home]] = at[home]
            k = at >= first[row]  # the pair meets in the later one's shard, where that one is a member
            row, at, home = row[k], at[k], home[k]
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), b.column(1).take(pa.array(row)), pa.array(at.astype(np.int64)), pa.array(home)], ["fp", "first", "shard", "home"])

    routed = cut(classes.select("fp", "first").mapInArrow(frugal(route), "fp long, first long, shard long, home boolean"), "routed")
    sizes = routed.groupBy("shard").agg(F.count_if("home").alias("members"), F.count("*").alias("rows")).where("members > 0")
    # at most 4 * shard members and 16 * shard visitors meet in a task: a shard beyond is tiled
    across, down = F.ceil(F.col("members") / (4 * shard)).cast("int"), F.ceil(F.col("rows") / (16 * shard)).cast("int")
    tiles = sizes.select("shard", across.alias("across"), down.alias("down"))
    slot = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    sent = routed.join(tiles, "shard")
    as_member = sent.where("home").select("fp", "first", "shard", F.lit(True).alias("home"), slot("across").alias("x"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("y"))
    as_visitor = sent.select("fp", "first", "shard", F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("x"), slot("down").alias("y"))
    # a member is a visitor of its own shard too: pairs of members meet twice, which the roots absorb

    def tile(t: pa.Table) -> pa.Table:
        home = t["home"].to_numpy()
        fps, firsts = t["fp"].to_numpy().view(np.uint64), t["first"].to_numpy()
        name, at = np.unique(firsts, return_inverse=True)  # ascending, so a root is the smallest id
        parent = np.arange(len(name))
        for i, j in near_pairs(fps[home], fps[~home], most):
            parent = unite(parent, at[home][i], at[~home][j])
        parent = settle(parent)
        k = np.flatnonzero(parent != np.arange(len(name)))
        return pa.table({"a": name[k], "b": name[parent[k]]})

    return as_member.unionByName(as_visitor).groupBy("shard", "x", "y").applyInArrow(tile, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, shard: int = 8192) -> DataFrame:
    """id, fingerprint as 16 hexadecimal digits, component_id; one row per document. Ids are whole numbers."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "prints")
    # a class all of whose ids are null still links others: it goes by a negative stand-in
    classes = cut(prints.groupBy("fp").agg(F.min("id").cast("long").alias("named")).select("fp", F.coalesce("named", F.lit(-(1 << 62)) + F.pmod("fp", F.lit(1 << 61))).alias("first"), "named"), "classes")
    found = components(near_classes(classes, most, shard), "a", "b")
    named = classes.join(found, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("component", "first").alias("c"), "named")
    if classes.where("named is null").limit(1).count():
        least = named.groupBy("c").agg(F.min("named").alias("component_id"))
        named = named.join(least, "c").select("fp", "component_id")
    else:
        named = named.select("fp", F.col("c").alias("component_id"))
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar(docs: DataFrame, text_col: str = "text", least: float = 0.8, most: int = 4, shard: int = 8192) -> DataFrame:
    """a, b (_copies.text_key) of each distinct text and its component by links of five-word similarity
    `least` or more, each checked exactly. The trees give the candidates within `most` bits; what lies
    beyond any radius at which they prune comes from bands of minima (see _copies for both)."""
    return near_copies(docs, lambda classes: near_classes(classes, most, shard), text_col, least)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op7_simhash": op7_simhash}
ORACLE: dict[str, str] = {}
