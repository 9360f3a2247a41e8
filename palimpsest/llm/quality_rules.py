"""Quality rules under weak supervision, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation estimates how often
each rule votes, and how often it is right, for good and for bad documents, without labels; a
document's posterior probability of being good then decides instead of all-must-pass.

Votes depend on a text alone. The maximisation needs no more than the number of documents per
pattern of votes: at most 3 to the power of the number of rules rows (531,441), whatever the input,
counted in one pass over the signals and combined before the shuffle. Every row's score is an
expression of its votes. Texts are read once and never shuffled: all signals are computed within a
row and written to the shared folder, a few numbers each.

The rules overlap on purpose: a kind of badness is known to several of them (marks, symbols,
punctuation and bare tokens all see text full of signs), so that documents which one rule alone
calls bad, against all others, are kept, while two or three that agree are believed. Nothing holds
the estimates but one document's weight of smoothing.

Repeated three-word windows are found by sorting, within the row, one long per window: the high
bits of its hash above its place. Windows that share these bits with a neighbour are then sorted and
compared by their words, so that equal hashes alone neither count nor hide others.

Defined results: a null or blank text has no words, counts of 0 and fails the base rule; an empty
table gives no rows; repeated rows each keep their row; null ids stay null; other columns are not
looked at. With one pattern of votes only, the posterior is the prior.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.llm._base import cut, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Runs of two or more ASCII marks, runs of any, words without letter or digit, ends of sentences, what is no letter.
MARKS, PUNCTUATION = r"[!-/:-@\[-`{-~]{2,}+", r"[!-/:-@\[-`{-~]++"
BARE, STOPS, LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])", r"[.!?…]++(?![^\x20\x09-\x0D])", r"\P{L}++"


def _shift(way: str, x: Column) -> Column:
    return F.call_function(way, x, F.col("b"))


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_stops, n_distinct."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.filter(F.split(text, SPACE), lambda x: x != "").alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\r\x0b\x0c"))) > 0)
    n = F.size("w")
    # one long per window: its hash with the lowest bits replaced by its place
    window = F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: _shift("shiftleft", F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).bitwiseOR(i.cast("long")))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    a = a.select(
        "id", "w", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"), lines.alias("lines"), count("[A-Z]").alias("n_upper"),
        count(MARKS).alias("n_marks"), count(PUNCTUATION).alias("n_punct"), count(BARE).alias("n_bare"), count(STOPS).alias("n_stops"),
        F.length(F.regexp_replace("text", LETTERLESS, "")).cast("long").alias("n_letters"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.length(F.bin(n)).cast("int").alias("b"),
    )
    a = a.select("*", F.sort_array(window).alias("s"))
    place = lambda x: x.bitwiseAND(_shift("shiftleft", F.lit(1).cast("long")) - 1).cast("int")

    def alike(x: Column, y: Column) -> Column:
        return F.coalesce(_shift("shiftright", x.bitwiseXOR(y)) == 0, F.lit(False))

    # few windows have the hash bits of a neighbour; only these are looked at by their words, which hold no space
    near = F.filter("s", lambda x, i: alike(x, F.get("s", i + 1)) | alike(x, F.get("s", i - 1)))
    spelt = F.transform(near, lambda x: F.struct(F.concat_ws(" ", *(F.get("w", place(x) + j) for j in range(3))).alias("u"), place(x).alias("p")))
    a = a.select("*", F.sort_array(spelt).alias("t")).drop("s")
    equal = lambda x, y: F.coalesce(x["u"] == y["u"], F.lit(False))
    twice = F.filter("t", lambda x, i: equal(x, F.get("t", i + 1)) | equal(x, F.get("t", i - 1)))
    a = a.select("*", F.sort_array(F.transform(twice, lambda x: x["p"])).alias("p"))
    # the words that the windows cover: three each, less the overlap with the window before
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get("p", i - 1), F.lit(-3)))), F.lit(0), lambda s, x: s + x)
    return a.select(
        "id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), "n_upper", "n_distinct",
        "n_marks", "n_punct", "n_bare", "n_stops", "n_letters",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 none, of which none is null."""
    n, c = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    mean = c / F.greatest(n, F.lit(1))
    per_word = lambda k, bad, good: vote(F.col(k) > bad * n, F.col(k) <= good * n)
    varied = (n >= 50) & (n < 5000)
    return {
        "length": vote(n < 20, n >= 50),
        "word_length": vote((mean < 3) | (mean > 10), (mean >= 4) & (mean <= 7)),
        "symbols": per_word("n_symbols", 0.1, 0.02),
        "marks": per_word("n_marks", 0.1, 0.02),
        "punctuation": per_word("n_punct", 0.5, 0.3),
        "bare": per_word("n_bare", 0.1, 0.02),
        "letters": vote(F.col("n_letters") < 0.7 * c, F.col("n_letters") >= 0.85 * c),
        "sentences": vote((n >= 20) & ((F.col("n_stops") * 100 < n) | (F.col("n_stops") * 3 > n)), (n >= 20) & (F.col("n_stops") * 60 >= n) & (F.col("n_stops") * 4 <= n)),
        "repeats": per_word("n_repeat_words", 0.3, 0.1),
        "dup_lines": vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), (F.col("n_lines") > 1) & (F.col("n_dup_lines") == 0)),
        "upper": vote(F.col("n_upper") > 0.3 * c, F.col("n_upper") <= 0.1 * c),
        "variety": vote(varied & (F.col("n_distinct") < 0.2 * n), varied & (F.col("n_distinct") > 0.4 * n)),
    }


#: Where the estimation begins: P(vote | bad) and P(vote | good) of the votes -1, 0, 1, for every rule.
BEGIN = ((0.4, 0.1, 0.5), (0.02, 0.08, 0.9))


def estimate(patterns: list[tuple[tuple[int, ...], int]], prior: float = 0.8, rounds: int = 200, least: float = 1e-7, weight: float = 1.0) -> tuple[float, list[dict[tuple[int, int], float]]]:
    """Expectation-maximisation over counted patterns of votes: the share of good documents, and per
    rule the probability of each vote for bad (0) and good (1) documents. `weight` documents of each
    kind, spread evenly over the votes, keep every probability over 0."""
    m = len(patterns[0][0]) if patterns else 0
    good, tables = prior, [{(z, v): BEGIN[z][v + 1] for z in (0, 1) for v in (-1, 0, 1)} for _ in range(m)]
    if not patterns:
        return good, tables
    votes, n = np.array([v for v, _ in patterns], np.int8), np.array([c for _, c in patterns], float)
    is_vote = [votes == v for v in (-1, 0, 1)]
    t = np.repeat(np.array(BEGIN)[:, :, None], m, 2)  # kind, vote, rule
    for _ in range(rounds):
        odds = log(good / (1 - good)) + sum(np.where(k, np.log(t[1, v] / t[0, v]), 0).sum(1) for v, k in enumerate(is_vote))
        p = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        soft = (n * (1 - p), n * p)
        new = (soft[1].sum() + weight) / (n.sum() + 2 * weight)
        t = np.array([[(soft[z] @ k + weight / 3) / (soft[z].sum() + weight) for k in is_vote] for z in (0, 1)])
        moved, good = abs(new - good), float(new)
        if moved < least:
            break
    return good, [{(z, v): float(t[z, v + 1, j]) for z in (0, 1) for v in (-1, 0, 1)} for j in range(m)]


def posterior(votes: tuple[int, ...], good: float, tables: list[dict[tuple[int, int], float]]) -> float:
    odds = log(good / (1 - good)) + sum(log(t[1, v] / t[0, v]) for t, v in zip(tables, votes))
    return 1 / (1 + exp(-max(-700.0, min(700.0, odds))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, the signals, base_failed, the rules' votes, quality (posterior), kept: the base rule holds
    and the posterior is `least` or more."""
    seen = cut(signals(docs, id_col, text_col), "signals")
    told = rules()
    names = list(told)
    counted = seen.select(*(v.alias(k) for k, v in told.items())).groupBy(*names).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(r[k] for k in names), r["n"]) for r in counted)
    good, tables = estimate(patterns)
    odds = F.lit(log(good / (1 - good)))
    for k, t in zip(names, tables):
        odds = odds + F.when(F.col(k) == 1, log(t[1, 1] / t[0, 1])).when(F.col(k) == -1, log(t[1, -1] / t[0, -1])).otherwise(log(t[1, 0] / t[0, 0]))
    out = seen.select("*", base_failed().alias("base_failed"), *(v.alias(k) for k, v in told.items()))
    out = out.withColumn("quality", 1 / (1 + F.exp(-odds)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", *names)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op4_quality_rules": op4_quality_rules}
ORACLE: dict[str, str] = {}
