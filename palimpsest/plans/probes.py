"""The shapes on the driver's tables, each beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.plans import shapes as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def probe(sql: str):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__], ORACLE[f.__name__] = run, sql
        return f

    return add


@probe("SELECT substr(sha1(text), 1, 12) AS hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1")
def content_hash_dedupe(t):
    return S.dedupe(t("documents"), "text", "doc_id")


@probe("SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii FROM documents")
def ascii_flag(t):
    return t("documents").select("doc_id", S.is_ascii(F.col("text")).alias("ascii"))


@probe("SELECT doc_id, strlen(text) AS n_bytes, length(text) AS n_chars FROM documents")
def byte_char_length(t):
    return t("documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"))


@probe("SELECT lang, sum(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')))::BIGINT AS n FROM documents GROUP BY lang")
def nonascii_by_lang(t):
    return t("documents").groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x7F]"))).cast("long").alias("n"))


@probe("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS text FROM documents")
def golden_normalize(t):
    return t("documents").select("doc_id", S.normalize_listing(F.col("text")).alias("text"))


@probe("SELECT conv_id, string_agg('-- ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS listing FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def listing_by_conversation(t):
    return S.listing(t("conversations"), "conv_id", "turn", F.col("role"), F.col("text"))


@probe("""WITH RECURSIVE walk AS (
  SELECT conv_id, min(turn) AS turn, 0 AS step FROM conversations GROUP BY conv_id
  UNION ALL SELECT c.conv_id, c.turn, w.step + 1 FROM walk w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1)
SELECT conv_id, turn, step::INT AS step FROM walk""")
def chain_walk(t):
    return S.chain(t("conversations").withColumn("n", F.col("turn") + 1), "conv_id", "turn", "n")


@probe("SELECT event_id, (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= ts) AS o_orderdate FROM events")
def asof_lookup(t):
    return S.asof(t("events").select("event_id", "ts"), "ts", t("orders").select("o_orderdate").distinct(), "o_orderdate", ["o_orderdate"]).select("event_id", "o_orderdate")


@probe("SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_start FROM events")
def chunk_end(t):
    return S.chunk_ends(t("events").select("event_id", "user_id"), "user_id", "event_id", "event_id")


@probe("""SELECT user_id, event_id, before FROM (
  SELECT user_id, event_id, coalesce(sum(user_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM events) WHERE before < 20""")
def extent_prefix(t):
    rows = t("events").select("user_id", "event_id", (F.col("user_id") % 7 + 1).alias("n"))
    return S.extent_prefix(rows, "user_id", "event_id", "n", 20).select("user_id", "event_id", F.col("before").cast("long").alias("before"))


@probe("""SELECT user_id, event_id, value FROM (
  SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM events) WHERE most IS NULL OR value > most""")
def stale_run_filter(t):
    return S.drop_stale_runs(t("events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@probe("""WITH terms AS (
  SELECT substr(p_type, 1, 4) AS code, p_name AS name, 0 AS r, p_partkey FROM part WHERE p_retailprice > 1500
  UNION ALL SELECT p_brand, p_type, 1, p_partkey FROM part WHERE p_size > 40),
best AS (SELECT code, name FROM terms QUALIFY row_number() OVER (PARTITION BY code ORDER BY r, p_partkey) = 1)
SELECT p_partkey, c.code, coalesce(b.name, '«class ' || c.code || '»') AS name
FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN substr(p_type, 1, 4) WHEN p_size > 5 THEN p_brand ELSE p_name END AS code FROM part) c LEFT JOIN best b ON c.code = b.code""")
def term_precedence(t):
    p, head = t("part"), F.substring("p_type", 1, 4)
    rank = lambda n: F.struct(F.lit(n), "p_partkey").alias("rank")
    own = p.where("p_retailprice > 1500").select(head.alias("code"), F.col("p_name").alias("name"), rank(0))
    more = p.where("p_size > 40").select(F.col("p_brand").alias("code"), F.col("p_type").alias("name"), rank(1))
    codes = p.select("p_partkey", F.when(F.col("p_size") > 25, head).when(F.col("p_size") > 5, F.col("p_brand")).otherwise(F.col("p_name")).alias("code"))
    return S.resolve_terms(codes, own.unionByName(more))


@probe("""WITH cur AS (SELECT c_custkey AS code, c_name AS name FROM customer WHERE c_acctbal < 3000), old AS (SELECT o_custkey AS code, 'order ' || min(o_orderkey) AS name FROM orders GROUP BY o_custkey)
SELECT * FROM cur UNION ALL SELECT * FROM old WHERE code NOT IN (SELECT code FROM cur)""")
def dictionary_overlay(t):
    current = t("customer").where("c_acctbal < 3000").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    classic = t("orders").groupBy(F.col("o_custkey").alias("code")).agg(F.concat(F.lit("order "), F.min("o_orderkey").cast("string")).alias("name"))
    return S.overlay(current, classic, ["code"])


@probe("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN p_name || ' (id ' || p_partkey || ')' ELSE p_name END AS label FROM part")
def label_disambiguation(t):
    return S.disambiguate(t("part"), ["p_brand"], "p_name", "p_partkey").select("p_partkey", "label")


@probe("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unlisted(t):
    return S.lacking(t("part").select("p_partkey"), t("lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@probe("SELECT c.conv_id, c.turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.role <> 'user' AND length(d.text) > length(c.text))")
def text_not_on_any_card(t):
    c = t("conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    shown = c.where("role <> 'user'").groupBy("conv_id").agg(F.max("n").alias("most"))
    return c.where("role = 'user'").join(shown, "conv_id", "left").where("most is null or most <= n or n is null").select("conv_id", "turn")


@probe("SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_totalprice) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def optional_parent(t):
    per = t("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("largest"))  # a third of the rows reach the join
    return t("customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "largest")


@probe("SELECT l_shipmode AS pattern, count(DISTINCT l_orderkey) AS files FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def structure_statistics(t):
    rows = t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("pattern"), F.col("l_orderkey").alias("file_id"))
    return S.structure_statistics(rows, "pattern")


@probe("SELECT CASE WHEN quality = 0 THEN 'fail' WHEN toxic = 1 THEN 'skip' WHEN quality = 1 THEN 'pass' ELSE 'plaintext' END AS outcome, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def outcome_counts(t):
    both = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return S.outcomes(both.select(F.when(F.col("quality") == 0, "bad").alias("error"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("skipped"), F.col("quality").isNull().alias("plain")))


@probe("SELECT lower(w) AS folded, arg_min(w, doc_id) AS spelling, count(*) AS uses FROM (SELECT doc_id, regexp_extract(text, '^[A-Za-z]+') AS w FROM documents) GROUP BY 1")
def first_spelling(t):
    return S.first_spelling(t("documents").select("doc_id", F.regexp_extract("text", "^[A-Za-z]+", 0).alias("w")), "w", "doc_id")


@probe("""WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 30), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 20)
SELECT *, '-' AS change FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, '+' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def line_diff(t):
    rows = t("lineitem")
    return S.changed_lines(rows.where("l_quantity < 30").select("l_partkey", "l_suppkey"), rows.where("l_quantity > 20").select("l_partkey", "l_suppkey"))


@probe("""SELECT o_orderkey, told, found FROM (SELECT o_orderkey, length(o_orderpriority)::BIGINT AS told, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS found FROM orders) WHERE told <> found""")
def counts_disagree(t):
    told = t("orders").select("o_orderkey", F.length("o_orderpriority").alias("n"))
    return S.disagreeing(told, t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "n")


@probe("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000")
def size_filter(t):
    return t("documents").where("n_chars <= 2000").select("doc_id", "n_chars")


@probe("SELECT CASE WHEN html LIKE '%lang=\"en\"%' THEN 'stack' WHEN html LIKE '%lang=\"de\"%' THEN 'project' WHEN html LIKE '<!DOCTYPE%' THEN 'script' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1")
def kind_dispatch(t):
    h = F.col("html")
    return t("pages").groupBy(F.when(h.contains('lang="en"'), "stack").when(h.contains('lang="de"'), "project").when(h.startswith("<!DOCTYPE"), "script").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


@probe("SELECT source, max(CASE WHEN n_chars < 10 THEN 1 ELSE 0 END)::INT AS status FROM documents GROUP BY source")
def status_rollup(t):
    return S.statuses(t("documents"), "source", F.col("n_chars") < 10)


@probe("SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS label FROM orders")
def ordinal_label(t):
    return t("orders").select("o_orderkey", S.ordinal(F.col("o_orderkey")).alias("label"))


@probe("SELECT p_partkey, CASE WHEN regexp_matches(w, '(s|x|ch|sh)$') THEN w || 'es' WHEN regexp_matches(w, '[^aeiou]y$') THEN regexp_replace(w, 'y$', 'ies') ELSE w || 's' END AS plural FROM (SELECT p_partkey, lower(p_name) AS w FROM part)")
def plural_rule(t):
    return t("part").select("p_partkey", S.plural(F.lower("p_name")).alias("plural"))


@probe("SELECT error, count(*) AS n, max(o_orderkey) AS example FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_orderpriority || o_orderstatus END AS error FROM orders) WHERE error IS NOT NULL GROUP BY error ORDER BY n DESC, error LIMIT 25")
def top_errors(t):
    return S.top_errors(t("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.concat("o_orderpriority", "o_orderstatus")).alias("error")), "error", "o_orderkey")
