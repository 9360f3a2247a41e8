"""Line dedup by site-relative frequency, in DataFrame functions alone.

A line's ratio is the number of its host's pages that hold it, over all pages of the host. Lines
beyond `ratio` on at least `least_pages` pages (three by default, as fewer is no habit of a site) are
the host's boilerplate and leave its pages; the ratio decides alike for hosts of every size. Where
`least_pages` is None a line must also beat chance: two deviations above what `ratio` makes likely, at
most AMPLE pages, so that a few near copies in a small host don't take each other's lines. With
`distinct` all rows of one host and text count as one page: copies are not boilerplate.

Lines are counted by host and 128 bits of hash, each once per page and combined before the
shuffle, so neither a hot host nor a hot line gathers in a task. What is dropped is applied in
one of two ways with equal results. Where the boilerplate is at most `broadcast_rows` lines in all
and `host_rows` for a host, counted beforehand, it is broadcast as one array per host and nothing
else moves. Beyond, only the pages' line hashes meet it, spread by host and hash, and the places of
hits - of each page its own alone - join the pages again.

Defined results: a null text stays null with no lines; white space around a line does not count in
comparing lines but stays in kept ones; blank lines always stay; a null host is a host of its own;
repeated rows count as pages of their own, or with `distinct` all rows of one host and text as one page; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.llm._base import cut, fresh, quoted, table

RATIO = 0.05
#: Pages that a repetition needs, however small the host is, and that suffice for one beyond the ratio.
FEWEST, AMPLE = 3, 10


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without port or user; the whole text if it has none."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.when(url.isNotNull(), F.lower(F.when(host != "", host).otherwise(url)))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def _sign(line: Column) -> Column:
    return F.struct(F.xxhash64(_trimmed(line)).alias("a"), F.xxhash64(F.lit(1), _trimmed(line)).alias("b"))


def _page_key(distinct: bool) -> list[Column]:
    return [F.xxhash64("body").alias("ka"), F.xxhash64(F.lit(1), "body").alias("kb")] if distinct else []


def boilerplate(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, least_pages: int | None = FEWEST, distinct: bool = False) -> DataFrame:
    """host, a, b (hash of the line), n (pages with it), pages (of the host). distinct: copies of a text are one page."""
    given = pages.select(host.alias("host"), F.col(text_col).alias("body"))
    lines = F.filter(F.split("body", "\n"), lambda x: _trimmed(x) != "")
    held, whole = given.select("host", *_page_key(distinct), F.explode(F.array_distinct(F.transform(lines, _sign))).alias("s")), given
    if distinct:
        held, whole = held.distinct(), given.select("host", *_page_key(distinct)).distinct()
    counted = held.groupBy("host", "s.a", "s.b").agg(F.count("*").alias("n"))
    totals = whole.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("pages"))
    out = counted.where(F.col("n") >= (FEWEST if least_pages is None else least_pages)).join(totals, F.col("host").eqNullSafe(F.col("h")))
    if least_pages is None:
        chance = ratio * F.col("pages") + 2 * F.sqrt(ratio * (1 - ratio) * F.col("pages"))
        out = out.where(F.col("n") >= F.least(F.lit(float(AMPLE)), chance))
    return out.where(F.col("n") > ratio * F.col("pages")).select("host", "a", "b", "n", "pages")


def drop_lines(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, least_pages: int | None = FEWEST, broadcast_rows: int = 200_000, host_rows: int = 256, distinct: bool = False) -> DataFrame:
    """The rows with boilerplate lines taken out of text_col, and n_lines and n_dropped after them
    (under other names where these are taken)."""
    found = cut(boilerplate(pages, host, text_col, ratio, least_pages, distinct).select("host", F.struct("a", "b").alias("s")), "boilerplate")
    h, gone, lines, h2, k, k2 = fresh(pages, "host_", "gone_", "lines_", "host2_", "key_", "key2_")
    n_lines, n_dropped = fresh(pages, "n_lines", "n_dropped")
    rows = pages.withColumn(h, host)
    sizes = found.groupBy("host").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    all_lines = F.split(text_col, "\n")
    if (sizes["n"] or 0) <= broadcast_rows and (sizes["most"] or 0) <= host_rows:
        told = F.broadcast(found.groupBy(F.col("host").alias(h2)).agg(F.collect_list("s").alias(gone)))
        rows = rows.join(told, F.col(h).eqNullSafe(F.col(h2)), "left")
        left = F.filter(all_lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col(gone), _sign(x)))
    else:
        # pages of equal host and text lose the same lines, so these two name the pages' hits
        rows = rows.withColumn(k, F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(1), F.col(text_col)).alias("b")))
        each = rows.select(F.col(h).alias("host"), F.col(k).alias("k"), F.posexplode(F.transform(all_lines, _sign)).alias("p", "s"))
        each = each.alias("e").join(found.alias("f"), F.col("e.host").eqNullSafe(F.col("f.host")) & (F.col("e.s") == F.col("f.s")), "left_semi")
        hits = each.groupBy(F.col("host").alias(h2), F.col("k").alias(k2)).agg(F.array_sort(F.collect_set("p")).alias(gone))
        rows = rows.join(hits, F.col(h).eqNullSafe(F.col(h2)) & (F.col(k) == F.col(k2)), "left")
        # the runs of lines between one dropped place and the next, and those after the last
        before = F.transform(gone, lambda p, j: F.slice(all_lines, F.coalesce(F.get(F.col(gone), j - 1), F.lit(-1)) + 2, p - F.coalesce(F.get(F.col(gone), j - 1), F.lit(-1)) - 1))
        left = F.flatten(F.concat(before, F.array(F.slice(all_lines, F.element_at(gone, -1) + 2, F.size(all_lines)))))
    rows = rows.withColumn(lines, F.when(F.col(gone).isNull(), all_lines).otherwise(left))
    kept = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    n_all = F.coalesce(F.size(all_lines), F.lit(0))
    out = [F.when(F.col(text_col).isNotNull(), kept).alias(c) if c == text_col else F.col(quoted(c)) for c in pages.columns]
    n = F.when(F.col(text_col).isNull(), 0).otherwise(n_all)
    return rows.select(*out, n.cast("long").alias(n_lines), F.when(F.col(text_col).isNull(), 0).otherwise(n_all - F.size(lines)).cast("long").alias(n_dropped))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_lines(docs, F.col("source"), distinct=True)


SQL = f"""
WITH lines AS (
  SELECT r, source, body, i, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key
  FROM (SELECT row_number() OVER () AS r, source, text AS body, string_split(text, chr(10)) AS ls FROM documents) d, unnest(range(len(ls))) AS u(i), LATERAL (SELECT ls[i + 1] AS line)),
counted AS (SELECT source, key, count(DISTINCT body) AS n FROM lines WHERE key <> '' GROUP BY ALL),
totals AS (SELECT source, count(DISTINCT text) + max((text IS NULL)::INT) AS pages FROM documents GROUP BY source),
gone AS (
  SELECT c.source, c.key FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {FEWEST} AND c.n > {RATIO}::DOUBLE * t.pages),
cleaned AS (
  SELECT l.r, count(*) AS n_lines, count(g.key) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.key IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.source IS NOT DISTINCT FROM g.source AND l.key = g.key GROUP BY l.r)
SELECT d.doc_id, d.source, c.text, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_dropped, 0)::BIGINT AS n_dropped
FROM (SELECT row_number() OVER () AS r, * FROM documents) d LEFT JOIN cleaned c ON d.r = c.r
"""
QUERIES: dict[str, Callable] = {"op5_line_dedup": op5_line_dedup}
ORACLE: dict[str, str] = {"op5_line_dedup": SQL}
