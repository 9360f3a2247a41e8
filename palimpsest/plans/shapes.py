"""Relational operators of the decoders' tables in general form.

Each takes DataFrames and column names, so that the same code serves decoded files and any other
table. probes.py holds them against SQL on the driver's tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def content_hash(data: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-1 of a binary or string: to show, not to compare by."""
    return F.substring(F.sha1(data.cast("binary")), 1, 12)


def dedupe(files: DataFrame, data: str, order: str) -> DataFrame:
    """hash, copies, and the first of `order` for each content; combines before its one shuffle.
    Contents are told apart by the whole SHA-1, of which the hash shows the first 12 digits."""
    told = files.groupBy(F.sha1(F.col(data).cast("binary")).alias("sha")).agg(F.count("*").alias("copies"), F.min(order).alias("first"))
    return told.select(F.substring("sha", 1, 12).alias("hash"), "copies", "first")


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def outcomes(results: DataFrame) -> DataFrame:
    """outcome, n: how many results failed (error), were skipped, are plain text or passed."""
    outcome = F.when(F.col("error").isNotNull(), "fail").when(F.col("skipped"), "skip").when(F.col("plain"), "plaintext").otherwise("pass")
    return results.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def changed_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of both and change: the rows of `before` that `after` lacks (-) and the other way round
    (+), as often as they are lacking; counts combine before the one shuffle."""
    names = before.columns
    both = before.withColumn("_n", F.lit(-1)).unionByName(after.withColumn("_n", F.lit(1))).groupBy(*names).agg(F.sum("_n").alias("_n"))
    rows = both.where("_n != 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))))
    return rows.select(*names, F.when(F.col("_n") < 0, "-").otherwise("+").alias("change"))


def disagreeing(told: DataFrame, found: DataFrame, on: str, n: str) -> DataFrame:
    """on, told, found: where the number that a file tells is not that of the rows found in it."""
    counted = found.groupBy(F.col(on).alias("_on")).agg(F.count("*").alias("found"))
    both = told.select(on, F.col(n).cast("long").alias("told")).join(counted, F.col(on) == F.col("_on"), "left").drop("_on")
    return both.withColumn("found", F.coalesce("found", F.lit(0))).where("told != found")


def statuses(rows: DataFrame, group: str | None, failed: Column) -> DataFrame:
    """status: 1 where any row of a group (or of all rows) failed, else 0."""
    by = rows.groupBy(group) if group else rows.groupBy()
    return by.agg(F.coalesce(F.max(failed.cast("int")), F.lit(0)).alias("status"))


def lacking(rows: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """The rows that no list names."""
    return rows.join(listed.select(on).distinct(), on, "left_anti")


def normalize_listing(text: Column) -> Column:
    """Lines without trailing blanks, and no blank lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def listing(rows: DataFrame, group: str, order: str, head: Column, body: Column) -> DataFrame:
    """One text per group: its non-empty bodies in order, each under its heading. A group is one
    file's listing, which the formats bound."""
    part = F.when(F.length(body) > 0, F.concat(F.lit("-- "), head, F.lit("\n"), body))
    made = rows.select(group, F.col(order).alias("o"), part.alias("p")).where("p is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda s: s["p"]), "\n\n")
    return made.groupBy(group).agg(joined.alias("listing"))


def chain(rows: DataFrame, group: str, key: str, following: str) -> DataFrame:
    """group, key, step: the rows reached from each group's smallest key by following links, for
    links that only lead to larger keys. A row is on the chain until the first link that no row
    answers, so a window finds all steps at once, without a recursion per step."""
    w = Window.partitionBy(group).orderBy(key)
    step = rows.select(group, key, (F.row_number().over(w) - 1).alias("step"), F.coalesce((F.lag(following).over(w) != F.col(key)).cast("int"), F.lit(0)).alias("broken"))
    cut = step.withColumn("broken", F.sum("broken").over(w))
    return cut.where("broken = 0").drop("broken")


def asof(probes: DataFrame, at: str, points: DataFrame, start: str, values: list[str], by: str | None = None) -> DataFrame:
    """Each probe with the values of the last point whose start is not after it; null before the
    first, and for a null time; points without a start are none. Points and probes are merged by time, so no pair but the answer is ever
    formed. Without `by` the merge is split into ranges of time at quantiles that are taken once, so that
    a time's range is a function of the time alone; each range knows the last point before it."""
    point = F.struct(F.col(start).alias("start_of_point"), *values)
    u = probes.select(F.struct(*probes.columns).alias("probe"), F.lit(None).cast(points.select(point.alias("p")).schema["p"].dataType).alias("point"), F.col(at).alias("at"), *([F.col(by).alias("by")] if by else []))
    points = points.where(F.col(start).isNotNull())
    p = points.select(F.lit(None).cast(u.schema["probe"].dataType).alias("probe"), point.alias("point"), F.col(start).alias("at"), *([F.col(by).alias("by")] if by else []))
    both = u.unionByName(p)
    if by:
        w = Window.partitionBy("by").orderBy("at", F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("hit", F.last("point", True).over(w))
    else:
        ranges = _ranges(both)
        w = Window.partitionBy("part").orderBy("at", F.col("probe").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        inner = ranges(both).withColumn("hit", F.last("point", True).over(w))
        # the last point of each range, at most one row per range; a window over them carries it on
        last = ranges(p).groupBy("part").agg(F.max("point").alias("own"))
        carried = last.unionByName(both.sparkSession.range(ranges.n).select(F.col("id").cast("double").alias("part"), F.lit(None).cast(last.schema["own"].dataType).alias("own")))
        carried = carried.groupBy("part").agg(F.max("own").alias("own"))
        carried = carried.select("part", F.last("own", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
        found = inner.join(F.broadcast(carried), "part", "left").withColumn("hit", F.coalesce("hit", "before"))
    found = found.withColumn("hit", F.when(F.col("at").isNotNull(), F.col("hit")))
    return found.where("probe is not null").select("probe.*", *(F.col(f"hit.{v}").alias(v) for v in values))


class _ranges:
    """Adds part, the number of the range of `at` that a row falls into, by one search in fixed bounds."""

    def __init__(self, rows: DataFrame):
        want = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        shares = F.array(*(F.lit(k / want) for k in range(1, want)))
        cuts = rows.agg(F.percentile_approx(self.key(rows), shares, 10_000).alias("b")).first()["b"] if want > 1 else []
        self.bounds = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
        self.n = len(self.bounds)

    @staticmethod
    def key(rows: DataFrame) -> Column:
        """A number in the order of `at`."""
        kind = dict(rows.dtypes)["at"]
        return F.col("at").cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col("at").cast("double")

    def __call__(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import Bucketizer

        keyed = rows.withColumn("key", F.coalesce(self.key(rows), F.lit(float("-inf"))))
        return Bucketizer(splits=self.bounds, inputCol="key", outputCol="part").transform(keyed).drop("key")


def chunk_ends(rows: DataFrame, group: str, order: str, start: str) -> DataFrame:
    """Each chunk with the start of the next as its end."""
    return rows.withColumn("next_start", F.lead(start).over(Window.partitionBy(group).orderBy(order)))


def extent_prefix(rows: DataFrame, group: str, order: str, count: str, need: int) -> DataFrame:
    """The extents, in order, of which a fork of `need` blocks has any, with the blocks before each."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(count).over(w), F.lit(0))).where(F.col("before") < need)


def drop_stale_runs(rows: DataFrame, group: str, order: str, start: str) -> DataFrame:
    """Style runs that start after all runs before them."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_most", F.max(start).over(w))
    return seen.where(F.col("_most").isNull() | (F.col(start) > F.col("_most"))).drop("_most")


def resolve_terms(codes: DataFrame, terms: DataFrame, code: str = "code") -> DataFrame:
    """Each code with the name of least rank, or its raw form. The dictionary, aggregated to one row
    per code, is joined by its key; its size decides how."""
    best = terms.groupBy(F.col("code").alias("_code")).agg(F.min_by("name", "rank").alias("name"))
    named = codes.join(best, F.col(code) == F.col("_code"), "left").drop("_code")
    return named.withColumn("name", F.coalesce("name", F.concat(F.lit("«class "), F.col(code), F.lit("»"))))


def overlay(current: DataFrame, classic: DataFrame, on: list[str]) -> DataFrame:
    """The current dictionary, and of the classic one what it lacks."""
    return current.unionByName(classic.join(current.select(*on).distinct(), on, "left_anti"))


def disambiguate(rows: DataFrame, scope: list[str], name: str, ident: str) -> DataFrame:
    """label: the name, with its id where the scope has the name more than once."""
    many = F.count("*").over(Window.partitionBy(*scope, name)) > 1
    return rows.withColumn("label", F.when(many, F.concat(F.col(name), F.lit(" (id "), F.col(ident).cast("string"), F.lit(")"))).otherwise(F.col(name)))


def first_spelling(rows: DataFrame, text: str, order: str) -> DataFrame:
    """For each text regardless of case, its spelling where it comes first."""
    return rows.groupBy(F.lower(text).alias("folded")).agg(F.min_by(text, order).alias("spelling"), F.count("*").alias("uses"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    ten, hundred = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    teen = hundred.between(11, 13)
    return F.concat(n.cast("string"), F.when(~teen & (ten == 1), "st").when(~teen & (ten == 2), "nd").when(~teen & (ten == 3), "rd").otherwise("th"))


def plural(name: Column) -> Column:
    """The regular English plural; words that name a stuff keep their form."""
    return (
        F.when(name.rlike("(^|.* )(text|raw data)$"), name).when(name.rlike("(s|x|ch|sh)$"), F.concat(name, F.lit("es")))
        .when(name.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(name, "y$", ""), F.lit("ies"))).otherwise(F.concat(name, F.lit("s")))
    )


def structure_statistics(objects: DataFrame, what: str, file: str = "file_id") -> DataFrame:
    """In how many files each kind of record, node or opcode is found: pairs are made distinct
    before they are counted, so that a kind found everywhere is no hot key."""
    return objects.select(what, file).distinct().groupBy(what).agg(F.count("*").alias("files"))


def top_errors(results: DataFrame, error: str, path: str, n: int = 25) -> DataFrame:
    """The n most frequent errors with an example each; ties go by the error's text."""
    return results.where(F.col(error).isNotNull()).groupBy(error).agg(F.count("*").alias("n"), F.max(path).alias("example")).orderBy(F.desc("n"), error).limit(n)
