"""Scripting dictionaries as a table, and the join that names codes.

`terms` has a row per term: scope (an application, '' for what every script has, or AppleScript),
kind (class, property, constant, event, label or plural), code (a label's is event/code), name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.functions.source import Dictionary
from palimpsest.plans import shapes

KINDS = {"class": "classes", "property": "properties", "constant": "constants", "event": "events", "label": "labels", "plural": "plurals"}
EVERYWHERE = ("", "AppleScript")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file: scope, kind, code and name, parted by tabs; # begins a comment. An empty scope stays empty."""
    rows = spark.read.schema("scope string, kind string, code string, name string").csv(path, sep="\t", comment="#", quote="", emptyValue="", nullValue="\x00", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.withColumn("scope", F.coalesce("scope", F.lit("")))


def with_classic(current: DataFrame, classic: DataFrame) -> DataFrame:
    """The current terms, and the classic ones for codes that those lack."""
    return shapes.overlay(current, classic, ["scope", "kind", "code"])


def merged(sources: DataFrame) -> DataFrame:
    """One term per scope, kind and code from several sources: the earliest source (source_rank) wins, within it
    the latest definition (def_order), and of labels the first."""
    label = F.col("kind") == "label"
    order = F.struct("source_rank", F.when(label, F.col("def_order")).otherwise(-F.col("def_order")))
    return sources.groupBy("scope", "kind", "code").agg(F.min_by("name", order).alias("name"))


def scope_of(app: Column) -> Column:
    """An application's scope by its name or path."""
    name = F.regexp_replace(F.regexp_replace(app, r"[/:]+$", ""), r"^.*[/:](?!/)", "")
    return F.when(app.rlike("^https?://"), F.lit("web service")).otherwise(F.regexp_replace(name, r"\.app$", ""))


def resolve(codes: DataFrame, terms: DataFrame, kind: str = "property", key: str = "key") -> DataFrame:
    """codes (key, code, scope of the application in whose block it stands, or null) with their names.

    A term of that application wins outright, by the order of kinds; among those that every script
    has the order of kinds decides before the scope. The two sort differently. Codes without a term
    are spelt raw. The join is on the code; each code's rows are those of three scopes at most, and
    the least of them is taken before any row is gathered.
    """
    order = {"class": ("class", "property", "constant"), "property": ("property", "class", "constant"), "event": ("event",)}[kind]
    kinds = F.create_map(*(x for n, k in enumerate(order) for x in (F.lit(k), F.lit(n))))
    places = F.create_map(*(x for n, s in enumerate(EVERYWHERE) for x in (F.lit(s), F.lit(n))))
    t = terms.where(F.col("kind").isin(*order)).select(F.col("scope").alias("t_scope"), F.col("code").alias("t_code"), "name", kinds[F.col("kind")].alias("k"), places[F.col("scope")].alias("s"))
    common = F.col("s").isNotNull()
    rank = F.when(common, F.struct(F.lit(1).alias("a"), F.col("k").alias("b"), F.col("s").alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), F.col("k").alias("b"), F.lit(0).alias("c")))
    found = codes.join(t, (F.col("code") == F.col("t_code")) & (common | F.col("scope").eqNullSafe(F.col("t_scope"))), "left")
    best = found.groupBy(key, "code", "scope").agg(F.min_by("name", F.when(F.col("name").isNotNull(), rank)).alias("name"))
    raw = F.concat(F.lit("«event " if kind == "event" else "«class "), F.col("code"), F.lit("»"))
    return best.withColumn("name", F.coalesce("name", raw))


def dictionaries(terms: DataFrame, most: int = 500_000) -> dict[str, Dictionary]:
    """The terms as dictionaries for the printer, which its tasks carry: more than `most` rows are refused."""
    rows = terms.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms: filter them by the scopes that the files use")
    out: dict[str, Dictionary] = {}
    for r in rows:
        getattr(out.setdefault(r["scope"], Dictionary()), KINDS[r["kind"]]).setdefault(r["code"], r["name"])
    return out
