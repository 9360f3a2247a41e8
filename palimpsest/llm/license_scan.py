"""License scan by diagonal voting, in DataFrame functions alone.

1. Every text's words give rolling hashes of `k` words with their places. Those that a template
   has leave the row and are joined with the templates' places, by hash and then by the words
   themselves; the templates are a fixed table in this module, so its broadcast is bounded.
2. A hit at word p of the text and word t of the template votes for the diagonal p - t. Votes are
   summed per document, template and diagonal.
3. Every diagonal is merged with its neighbours up to `drift` away: words put in or left out shift
   a copy's diagonal. A merged span so reaches no further than the template's length and twice the
   drift, and takes nothing away from any other.
4. Spans are verified: as many runs of the template's words stand in the span as `covered` of its
   length asks for; of overlapping ones the best stays, the first of equals. Phrases ask for all of
   theirs in one diagonal, which makes places of consecutive words exact.

Only hits are shuffled, by document, template and diagonal; a hot source has no key of its own.

Defined results: a null text counts as empty; documents without a label have base_labels and
labels "", first_word and last_word null, score 0; rows of equal id and text are scanned once and
each keep their row; a null id stays null; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palimpsest.llm._base import cut, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase -> label of the base scan
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label -> texts by which the method knows a license beyond the phrases
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license", "this work is licensed under a creative commons attribution license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.filter(F.split(lowered(text), _BREAK), lambda w: w != "")


def grams(w: Column, k: int) -> Column:
    """Hashes of all runs of k words of the column w, in order; the last k - 1, of fewer words, match none."""
    return F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k))))


def _templates() -> list[tuple[str, str, bool]]:
    out = [(label, phrase, True) for phrase, label in PHRASES.items()]
    return out + [(label, t, False) for label, ts in TEMPLATES.items() for t in ts]


def template_grams(spark: SparkSession, k: int) -> DataFrame:
    """t (template), label, base, n_t (its grams, 63 at most), at (place of the gram), gram, said (its words)."""
    rows = [(i, label, base, text.split(" ")) for i, (label, text, base) in enumerate(_templates())]
    if any(not 0 < len(r[3]) - (k - 1) < 64 for r in rows):
        raise ValueError("templates need 1 to 63 runs of k words")
    made = spark.createDataFrame(rows, "t int, label string, base boolean, w array<string>").withColumn("n_t", F.size("w") - (k - 1))
    told = F.transform(grams(F.col("w"), k), lambda g, at: F.struct(at.alias("at"), g.alias("gram"), F.concat_ws(" ", F.slice("w", at + 1, k)).alias("said")))
    return made.select("t", "label", "base", "n_t", F.inline(told)).where("at < n_t")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, drift: int = 6, covered: float = 0.8) -> DataFrame:
    """doc, sig, label, base, first, last (places of words), share: verified places of templates.
    sig tells apart the texts of one id."""
    known = template_grams(docs.sparkSession, k)
    hashes = sorted({r["gram"] for r in known.select("gram").collect()})  # as many as the templates have words
    given = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("sig"), words(F.col(text_col)).alias("w"))
    placed = F.transform(grams(F.col("w"), k), lambda g, p: F.struct(p.alias("p"), g.alias("gram")))
    held = F.filter(placed, lambda h: h["gram"].isin(hashes))
    said = F.transform(held, lambda h: F.struct(h["p"].alias("p"), h["gram"].alias("gram"), F.concat_ws(" ", *(F.get("w", h["p"] + j) for j in range(k))).alias("said")))
    # in one expression over w: a filter on it would be pushed below w and split the text for every word
    hits = given.select("doc", "sig", F.inline(said)).join(F.broadcast(known), ["gram", "said"])
    key = ["doc", "sig", "t", "label", "base", "n_t"]
    # the template's places on a diagonal as bits: rows of equal id and text vote for the same bits
    found = F.bit_or(F.expr("shiftleft(1L, at)"))
    votes = hits.withColumn("diagonal", F.col("p") - F.col("at")).groupBy(*key, "diagonal").agg(found.alias("bits"), F.min("p").alias("first"), (F.max("p") + (k - 1)).alias("last"))
    votes = cut(votes, "votes")  # both branches below start from it, and words are generated once
    exact = votes.where("base and bit_count(bits) = n_t").select("doc", "sig", "label", "base", "first", "last", F.lit(1.0).alias("share"))
    w = Window.partitionBy(*key).orderBy("diagonal").rangeBetween(-drift, drift)
    merged = votes.where("not base").select(*key, "diagonal", F.bit_or("bits").over(w).alias("bits"), F.min("first").over(w).alias("first"), F.max("last").over(w).alias("last"))
    merged = merged.withColumn("share", F.expr("bit_count(bits) / n_t")).where(F.col("share") >= covered)
    rank = F.struct("share", (-F.col("diagonal")).alias("before"))
    merged = merged.withColumn("best", F.max(rank).over(w) == rank).where("best")
    return exact.unionByName(merged.select("doc", "sig", "label", "base", "first", "last", "share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, drift: int = 6, covered: float = 0.8) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per document."""
    found = spans(docs, id_col, text_col, k, drift, covered)
    base = lambda c: F.when(F.col("base"), F.col(c))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    told = found.groupBy("doc", "sig").agg(
        F.count_if("base").alias("n_base"), F.min(base("first")).cast("long").alias("first_word"), F.max(base("first")).cast("long").alias("last_word"),
        listed(base("label")).alias("base_labels"), listed("label").alias("labels"), F.max("share").alias("score"),
    )
    rows = docs.select(F.col(id_col).alias("doc_"), F.xxhash64(text_col).alias("sig_"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    out = rows.join(told, rows["doc_"].eqNullSafe(told["doc"]) & (rows["sig_"] == told["sig"]), "left")
    return out.select(
        F.col("doc_").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(k: int = 2, drift: int = 6, covered: float = 0.8) -> str:
    """The same votes over words instead of hashes, for k = 2."""
    rows = ", ".join(f"({i}, '{label}', {str(base).lower()}, string_split('{text}', ' '))" for i, (label, text, base) in enumerate(_templates()))
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
template(t, label, base, tw) AS (VALUES {rows}),
told AS (
  SELECT t, label, base, len(tw) - 1 AS n_t, k, tw[k + 1] AS a, tw[k + 2] AS b
  FROM template, unnest(range(len(tw) - 1)) AS u(k)),
pairs AS (SELECT r, p, w[p + 1] AS a, w[p + 2] AS b FROM docs, unnest(range(len(w) - 1)) AS u(p)),
hits AS (SELECT r, t, label, base, n_t, p, k, p - k AS diagonal FROM pairs JOIN told USING (a, b)),
votes AS (SELECT r, t, label, base, n_t, diagonal, min(p) AS f, max(p) + 1 AS l, count(DISTINCT k) AS n FROM hits GROUP BY ALL),
merged AS (
  SELECT v.r, v.label, count(DISTINCT h.k) / v.n_t AS share
  FROM votes v JOIN hits h ON v.r = h.r AND v.t = h.t AND h.diagonal BETWEEN v.diagonal - {drift} AND v.diagonal + {drift}
  WHERE NOT v.base GROUP BY v.r, v.t, v.label, v.n_t, v.diagonal),
spans AS (
  SELECT r, label, true AS base, f, 1.0::DOUBLE AS share FROM votes WHERE base AND n = n_t
  UNION ALL
  SELECT r, label, false, NULL, share FROM merged WHERE share >= {covered}),
told_by AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(f) FILTER (base) AS first_word, max(f) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM spans GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs d LEFT JOIN told_by b ON d.r = b.r
"""


QUERIES: dict[str, Callable] = {"op3_license_scan": op3_license_scan}
ORACLE: dict[str, str] = {"op3_license_scan": _sql()}
