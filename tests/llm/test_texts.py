"""Operators on texts against brute force, and on the rows that break things: nulls, empty and very
long texts, repeated rows, ties, empty tables, extra columns with clashing names."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import license_scan, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdeéñß") for _ in range(R.randint(1, 9))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "<|endoftext|> İ ﬁ ΑΣ don't we'll ½"), (6, prose(30000)), (7, "same text here twice"), (7, "same text here twice"),
    (8, "Creative CC BY, cc-by General Public License. ALL RIGHTS RESERVED cc by"), (None, "no id here at all"), (9, "same text here twice"), (10, "a b c a b c\n\nx\nx\n x\n" * 5),
    (11, prose(5000) + "\nReleased under the MIT License.\n"), (12, "x\x85y z w 🙂 \x1c é"), (13, "## $$ %% && ** << >> || " * 40), (14, "Permission is hereby granted, free of charge, to any fine person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
]
SCHEMA = "doc_id long, text string, score double, n_words string, id string, n_tokens string, key_ string, w string, `dotted.name` string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, "n", "i", "t", "k", "w", "d") for i, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i, t):
    return (i is None, i or 0, t or "")


def test_token_counts(odd, none):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.prefix_counts(odd, PATH).collect())
    want = sorted((i or 0, len((t or "").encode()), n := len(LIBRARY.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in ODD)
    assert got == want
    assert token_counts.prefix_counts(none, PATH, tables=True).count() == 0


ALL_SIGNS = "".join(chr(k) for k in range(0x180))
TEXTS = ["Hello wörld, it's 42 days!! of  unbelievably long-windedness", "", "ab", "<|endoftext|> İx ab", "don't 'snow ''s I'll we'RE 're 'r '", ALL_SIGNS, "ΑΣ Σ, 中文字 12三 \x85 a\u3000b 🙂🙂 ǆ ﬁ", "e\u0301 cafe\u0301 a", "a\x1cb \u2028 x" * 3, "𝔘𝔫𝔦 Ⅷ ½² ١٢", "x" * 300]


def test_prefix_tables_answer_every_prefix():
    from palimpsest.llm._tokens import word_tokens

    for text in TEXTS:
        made = token_counts.PrefixCounts(text, word_tokens(PATH))
        want = [len(LIBRARY.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert made.counts.tolist() == want and made.total == want[-1], text
        for budget in range(0, made.total + 2):
            end = made.truncate(budget)
            assert want[end] <= budget and all(n > budget for n in want[end + 1 :])


def test_every_sign_alone_and_between_letters():
    """All signs up to U+017F and a sample of all others, by word and by the library."""
    from palimpsest.llm._tokens import word_tokens

    encoder, r = word_tokens(PATH), random.Random(9)
    signs = [chr(k) for k in range(0x180)] + [chr(r.choice([r.randrange(0x180, 0xD800), r.randrange(0xE000, 0x30000)])) for _ in range(1500)]
    for c in signs:
        for text in (c, f"a{c}b", f"it{c}s {c}{c} 'l{c}", f"Z{c}9{c}!"):
            want = LIBRARY.encode(text, add_special_tokens=False).ids
            assert encoder.ids(text).tolist() == want and encoder.count(text) == len(want) and token_counts.PrefixCounts(text, encoder).total == len(want), repr(text)


def test_recurrence_of_prefixes_against_the_library():
    from palimpsest.llm._prefix import Prefixes
    from palimpsest.llm._tokens import _BYTES

    made, model, r = Prefixes(PATH), LIBRARY.model, random.Random(4)
    pieces = [t.replace("</w>", "") for t in LIBRARY.get_vocab()]
    words = ["".join(r.choice(pieces) for _ in range(r.randint(1, 4))) for _ in range(1500)] + ["".join(r.choices(list(_BYTES.values()), k=9)) for _ in range(500)]
    for w in filter(None, words):
        assert list(made.counts(w)) == [len(model.tokenize(w[:k])) for k in range(1, len(w) + 1)], w


def test_stored_tables_answer_without_the_tokenizer(spark, odd):
    stored = token_counts.prefix_counts(odd.where("length(text) < 200 and doc_id is not null"), PATH, tables=True)
    for n in (0, 3, 10, 1000):
        got = stored.select("doc_id", token_counts.tokens_at(F.col("counts"), F.lit(n)).alias("at"), token_counts.chars_within(F.col("counts"), F.lit(n)).alias("within"), token_counts.fits(F.col("counts"), F.lit(n)).alias("fits")).collect()
        for r in got:
            texts = {t for i, t in ODD if i == r.doc_id}
            (text,) = texts
            want = [len(LIBRARY.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
            assert r.at == want[min(n, len(text))] and r.within == max(k for k, x in enumerate(want) if x <= n) and r.fits == (want[-1] <= n)


def test_other_tokenizer_files_go_through_their_library(spark):
    from palimpsest.llm._tokens import word_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), word_tokens(path)
    for text in ("Two  words, it's\nHere", "", "é <|endoftext|> x"):
        assert not encoder.apart and encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert token_counts.PrefixCounts(text, encoder).counts.tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_workers_hold_little(spark, monkeypatch):
    """A worker that counts for mixing and then encodes for packing holds the words of one of the two, only
    those that came again, and what it made of a slice of a batch; ids and counts stay the library's."""
    from palimpsest.llm import _tokens

    monkeypatch.setattr(_tokens, "_made", {})
    texts = [None, *("common words, " + "".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(2499))]
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500)), pa.array(texts)], ["doc_id", "text"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda _, f, schema: f)
    mixed = mixing.posteriors(docs, "text", (np.zeros((8, 3)), np.zeros(3)), PATH, "n", "p")
    packed = packing.encode(docs, PATH, 2, "doc_id", "text")
    encoder = _tokens.word_tokens(PATH)
    for f, used, other in ((mixed, "sizes", "words"), (packed, "words", "sizes"), (mixed, "sizes", "words")):
        got = list(f([batch]))
        assert [b.num_rows for b in got] == [1000, 1000, 500] and [k for b in got for k in b["doc_id"].to_pylist()] == [*range(2500)]
        if f is mixed:
            assert [n for b in got for n in b["n"].to_pylist()] == [len(x) for x in want] and [t for b in got for t in b["text"].to_pylist()] == texts
        else:
            assert [np.frombuffer(x, encoder.kind).tolist() for b in got for x in b["ids"].to_pylist()] == [[*x, 2] for x in want]
        assert {"common", "words", ","} <= set(getattr(encoder, used)) and len(getattr(encoder, used)) < 30 and not getattr(encoder, other)
    few = _tokens.Words(encoder.library.model, "H", most=2)
    for word in ["red", "green", "blue", "grey"] * 3:
        assert np.frombuffer(few[word], "<u2").tolist() == LIBRARY.encode(word, add_special_tokens=False).ids and len(few) <= 2


def test_stages_without_words_leave_none(spark, monkeypatch):
    """Tables of words are for the next task of their stage: counting and packing ids empties their worker.
    Texts go to the workers in small batches, and the session's setting is back afterwards."""
    from palimpsest.llm import _base, _tokens

    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    cut = lambda df, name: (seen.append((name, spark.conf.get(key))), _base.cut(df, name))[1]
    for m in (packing, mixing):
        monkeypatch.setattr(m, "cut", cut)
    docs = spark.createDataFrame([(k, f"one text {k}") for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    before = spark.conf.get(key)
    assert packing.pack_documents(docs, PATH).count() >= 30 and mixing.rates(docs, labels, PATH).count() == 30
    assert seen == [("ids", "1000"), ("posteriors", "1000")] and spark.conf.get(key) == before
    _tokens.word_tokens(PATH).raw("word word")
    assert _tokens._made and list(_base.frugal(lambda batches: iter(batches))([1])) == [1] and not _tokens._made


def test_packing_is_a_partition_of_all_ids(odd, none):
    got = packing.pack_documents(odd, PATH, shard_tokens=5000, with_ids=True).collect()
    sequences, documents = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault(r.doc_id, []).append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        n = sum(r.length for r in rows)
        assert n <= 4096 and n & (n - 1) == 0
    for i, t in ODD:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        rows = sorted(documents[i], key=lambda r: r.start)
        if i == 7:  # two equal rows: each id twice
            assert sum(r.length for r in rows) == 2 * len(ids)
            continue
        assert [x for r in rows for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in rows)
    assert packing.pack_documents(none, PATH).count() == 0


def test_bm25_neighbours_come_best_first():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3], [4, 5], [1, 2, 9], [3, 8, 8, 8], [7])]
    df = np.bincount([t for d in docs for t in set(d.tolist())], minlength=10)
    idf = np.log1p((5 - df + 0.5) / (df + 0.5)).astype(np.float32)
    shard = packing.Shard(docs, idf, np.mean([len(d) for d in docs]))
    assert shard.neighbours(docs[0], np.array([False, True, True, True, True])).tolist() == [2, 3]


def brute_rules(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup, at, covered = set(), 0, {}, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    for v in at.values():
        for i in v if len(v) > 1 else ():
            covered |= {i, i + 1, i + 2}
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(odd, none):
    got = quality_rules.judge(odd).collect()
    assert sorted(((r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((i or 0, *brute_rules(t)) for i, t in ODD)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judge(none).count() == 0


def test_estimate_separates_what_rules_agree_on():
    good, tables = quality_rules.estimate([((1, 1, 1), 900), ((-1, 1, 1), 60), ((1, -1, -1), 40)])
    p = [quality_rules.posterior(v, good, tables) for v in ((1, 1, 1), (-1, 1, 1), (1, -1, -1), (0, 0, 0))]
    assert p[0] > 0.9 and p[1] > 0.5 and p[2] < 0.1 and 0 < p[3] < 1


def brute_estimate(votes, prior=0.8, rounds=200, least=1e-7):
    """Expectation-maximisation by plain loops over documents."""
    m = len(votes[0])
    good, t = prior, {(z, j, v): quality_rules.BEGIN[z][v + 1] for z in (0, 1) for j in range(m) for v in (-1, 0, 1)}
    for _ in range(rounds):
        soft = []
        for d in votes:
            a, b = good, 1 - good
            for j, v in enumerate(d):
                a, b = a * t[1, j, v], b * t[0, j, v]
            soft.append(a / (a + b))
        new = (sum(soft) + 1) / (len(votes) + 2)
        for z in (0, 1):
            w = [p if z else 1 - p for p in soft]
            for j in range(m):
                for v in (-1, 0, 1):
                    t[z, j, v] = (sum(x for x, d in zip(w, votes) if d[j] == v) + 1 / 3) / (sum(w) + 1)
        moved, good = abs(new - good), new
        if moved < least:
            break
    return good, t, soft


def test_kept_is_the_estimate_over_documents_and_not_all_must_pass(spark):
    r = random.Random(3)
    sentence = lambda: " ".join(r.choice(VOCABULARY) for _ in range(12)) + "."
    texts = ["\n".join(sentence() for _ in range(r.randint(6, 20))) for _ in range(150)]
    texts += ["\n".join(sentence() + "\nmore" for _ in range(8)) for _ in range(6)]  # repeats lines, and is well otherwise
    texts += [" ".join(w + r.choice(("&&&", "%%%", "***")) for w in sentence().split() * 8) for _ in range(15)]
    texts += [" | ".join(r.choice(VOCABULARY) for _ in range(90)) for _ in range(15)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    names = list(quality_rules.rules())
    got = sorted(quality_rules.judge(docs).collect(), key=lambda x: x.doc_id)
    votes = [tuple(x[k] for k in names) for x in got]
    good, t, _ = brute_estimate(votes)
    for x, d in zip(got, votes):
        odds = np.log(good / (1 - good)) + sum(np.log(t[1, j, v] / t[0, j, v]) for j, v in enumerate(d))
        assert abs(x.quality - 1 / (1 + np.exp(-odds))) < 1e-6 and x.kept == (not x.base_failed and odds >= 0)
    assert all(x.kept for x in got[:150]) and not any(x.kept for x in got[156:])
    assert any(x.kept and -1 in d for x, d in zip(got, votes))


def test_equal_windows_are_told_by_words_alone(spark, monkeypatch):
    from pyspark.sql import functions

    real = functions.xxhash64
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: functions.length(c[0]).cast("long") if len(c) == 3 else real(*c))  # nearly all hashes clash
    texts = [" ".join(R.choice(("aa", "bb", "cc", "d")) for _ in range(n)) for n in (5, 12, 40, 90)]
    got = quality_rules.signals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.id: x.n_repeat_words for x in got} == {k: brute_rules(t)[4] for k, t in enumerate(texts)}


def brute_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        hits = [k for k in range(len(ws)) if ws[k : k + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(odd, none):
    got = license_scan.scan(odd).collect()
    assert len(got) == len(ODD)
    assert sorted(((r.doc_id or 0), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.n_base) == sorted((i or 0, *b) for i, t in ODD if (b := brute_licenses(t))[1])
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == sorted((i or 0, brute_licenses(t)[0]) for i, t in ODD)
    by = {r.doc_id: r for r in got}
    assert by[11].labels == "mit" and by[14].labels == "mit" and by[14].score > 0.8 and by[1].labels == "" and by[1].score == 0
    assert license_scan.scan(none).count() == 0


def test_license_scan_of_copies_among_pieces(spark):
    whole = "released under the mit license"
    texts = ["the mit license the mit license " + whole + " the mit license the mit license", "the mit license " * 40 + whole, whole + " " + prose(9) + " " + whole, "Released - under the fine MIT License!", "the mit license " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    assert got[0] == got[1] == got[2] == ("mit", 1.0) and got[4] == ("", 0.0) and got[3][0] == ""
    assert license_scan.spans(docs).groupBy("doc").count().where("doc < 3").orderBy("doc").collect() == [(0, 1), (1, 1), (2, 2)]
    said = license_scan.TEMPLATES["bsd"][0].split()
    for n in (0, 3):  # words put in and left out
        text = " ".join([*said[:6], *["extra"] * n, *said[6:12], *said[13:]])
        (r,) = license_scan.scan(spark.createDataFrame([(1, prose(20) + " " + text + " " + prose(20))], "doc_id long, text string")).collect()
        assert r.labels == "bsd" and 0.8 <= r.score < 1


def test_line_dedup_both_ways(spark):
    rows = [(k, f"h{k % 2}", "\n".join(["Menu " if k % 3 else "menu?", f"line {k}", "", "  Menu"])) for k in range(40)] + [(99, "h0", None), (98, None, "Menu\nMenu"), (97, "h0", ""), (97, "h0", "")]
    pages = spark.createDataFrame(rows, "doc_id long, host string, text string")
    for most in (1000, 0):
        got = {r.doc_id: r for r in line_dedup.drop_lines(pages, F.col("host"), ratio=0.5, least_pages=3, broadcast_rows=most).collect()}
        assert got[1].text == "line 1\n" and got[1].n_lines == 4 and got[1].n_dropped == 2, most
        assert got[3].text == "menu?\nline 3\n" and got[99].text is None and got[99].n_lines == 0
        assert got[98].text == "Menu\nMenu" and got[97].text == ""
        assert len(got) == 43
    assert line_dedup.drop_lines(pages.where("false"), F.col("host")).count() == 0
    clash = pages.withColumn("n_lines", F.lit("mine")).withColumn("host_", F.lit("mine"))
    out = line_dedup.drop_lines(clash, F.col("host"))
    assert out.columns == ["doc_id", "host", "text", "n_lines", "host_", "n_lines_", "n_dropped"] and out.first().n_lines == "mine"
    hosts = spark.createDataFrame([("http://u:p@A.example:80/x?y",), ("nohost",), (None,)], "u string").select(line_dedup.url_host(F.col("u"))).collect()
    assert [h[0] for h in hosts] == ["a.example", "nohost", None]


def test_line_dedup_by_the_ratio_at_every_size(spark):
    host = lambda s, pages, n: [(s, f"Menu of {s}\nPage {k} of {s}." if k < n else f"Page {k} of {s}.") for k in range(pages)]
    rows = host("a", 3, 3) + host("b", 40, 3) + host("c", 40, 2) + host("d", 300, 15) + host("e", 300, 16) + [("a", "copied\nlines")] * 20 + [("e", None)]
    docs = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(rows)], "doc_id long, source string, text string").repartition(3)
    for how in ({}, {"broadcast_rows": 0}, {"host_rows": 0}):
        got = line_dedup.drop_lines(docs, F.col("source"), distinct=True, **how).collect()
        assert {r.source for r in got if "Menu" in (r.text or "")} == {"c", "d"} and sum(r.text == "copied\nlines" for r in got) == 20 and len(got) == len(rows)
    mixed = [("z", "\n".join(["top", f"x{k}", "mid", "mid", f"y{k}", "", "end"])) for k in range(5)]
    pages = spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(mixed)], "doc_id long, source string, text string")
    assert sorted(r.text for r in line_dedup.drop_lines(pages, F.col("source"), broadcast_rows=0).collect()) == [f"x{k}\ny{k}\n" for k in range(5)]


def brute_fingerprint(text):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(ws[k : k + 4]) for k in range(max(len(ws) - 3, 1))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, odd, none):
    got = {(r.doc_id or 0): r for r in simhash.near_duplicates(odd).collect()}
    for i, t in ODD:
        assert got[i or 0].fingerprint == f"{brute_fingerprint(t):016x}", i
    assert got[9].component_id == got[7].component_id == 7 and got[2].component_id == got[3].component_id == 1 and got[0].component_id is None
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_shards_find_every_link(spark):
    r = np.random.default_rng(2)
    fps = r.integers(0, 1 << 63, 700, np.int64).view(np.uint64)
    near = fps[:200] ^ np.array([sum(1 << int(b) for b in r.choice(64, r.integers(1, 6), False)) for _ in range(200)], np.uint64)
    fps = np.unique(np.concatenate([fps, near, near[:100] ^ np.uint64(0b1011)]))
    classes = spark.createDataFrame([(int(f), k) for k, f in enumerate(fps.view(np.int64))], "fp long, first long")
    found = simhash.components(simhash.near_classes(classes, 4, shard=16), "a", "b").collect()
    parent = simhash.settle(simhash.unite(np.arange(len(fps)), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)))
    assert {x.node: x.component for x in found} == {k: int(p) for k, p in enumerate(parent) if (parent == p).sum() > 1}


def test_quality_classifier(spark, odd, none):
    good = [(k, prose(60) + ".") for k in range(400)]
    bad = [(k, "!! ".join(w.upper() for w in prose(60).split())) for k in range(400, 500)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 400)) for k in range(500)] + [(3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels, bits=14)
    got = quality_classifier.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id < 400) for r in held]) > 0.97
    out = quality_classifier.score(odd, model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    kept = quality_classifier.accepted(odd.withColumn("predicted", F.lit("mine")), model, threshold=0.5)
    assert kept.columns == [*odd.columns, "predicted"] and kept.dtypes[2] == ("score", "double")
    assert sorted(key(r.doc_id, r.text) for r in kept.collect()) == sorted(key(i, t) for (i, t), r in zip(ODD, [None] * len(ODD)) if quality_classifier.score(spark.createDataFrame([(i, t)], "doc_id long, text string"), model).first().score >= 0.5)
    assert quality_classifier.score(none, model).count() == 0
    untaught = quality_classifier.train(docs, labels.where("false"), bits=14)
    assert {r.score for r in quality_classifier.score(docs, untaught).collect()} == {0.5}


def test_follow_the_regularised_leader_against_plain_loops():
    import math

    import pyarrow as pa

    from palimpsest.llm import _features

    texts, bits = [prose(R.randint(0, 30)) + R.choice(("", "!", " A")) for _ in range(60)], 12
    y = np.array([[k % 2, -1 if k % 5 == 0 else int(k % 3 == 0)] for k in range(60)])
    w, bias = _features.fit(pa.array(texts), y, bits, epochs=2)
    docs = []
    for lo, hi, row, slot in _features.features(pa.array(texts), bits):
        for k in range(hi - lo):
            at = slot[row == k].tolist()
            docs.append({**{s: at.count(s) / math.sqrt(len(at)) for s in set(at)}, 1 << bits: 1.0})
    for column in (0, 1):
        z, n, order = {}, {}, np.random.default_rng(7)
        weight = lambda s: 0.0 if abs(z.get(s, 0)) <= 0.3 else -(z[s] - math.copysign(0.3, z[s])) / ((0.05 + math.sqrt(n[s])) / 2.0 + 0.01)  # noqa: B023, E731
        known = [k for k in range(60) if y[k, column] >= 0]
        for _ in range(2):
            for k in order.permutation(len(known)):
                x, t = docs[known[k]], y[known[k], column]
                old = {s: weight(s) for s in x}
                g = 1 / (1 + math.exp(-sum(old[s] * v for s, v in x.items()))) - t
                for s, v in x.items():
                    before = n.get(s, 0.0)
                    n[s] = before + (g * v) ** 2
                    z[s] = z.get(s, 0.0) + g * v - (math.sqrt(n[s]) - math.sqrt(before)) / 2.0 * old[s]
        assert abs(bias[column] - weight(1 << bits)) < 1e-9 and all(abs(w[s, column] - weight(s)) < 1e-9 for s in z if s < 1 << bits)
        got = _features.scores(pa.array(texts), w, bias, bits)[:, column]
        assert np.allclose(got, [sum(weight(s) * v for s, v in x.items()) for x in docs])


def brute_rates(n, p, goal, ridge):
    """Projected gradient with momentum over documents, until nothing moves."""
    k, total = p.shape[1], n.sum()
    r = ahead = np.ones(len(n))
    t = 1.0
    for _ in range(200_000):
        e = (ahead * n) @ p / total - goal
        new = np.maximum(0, ahead - (p @ e + ridge * k * (ahead - 1)) / (1 + ridge * k))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        if (ahead - new) @ (new - r) > 0:  # momentum uphill: begin anew
            after = 1.0
        moved, ahead, r, t = np.abs(new - r).max(), new + (t - 1) / after * (new - r), new, after
        if moved < 1e-12:
            break
    return r


def test_rates_are_the_nonnegative_least_squares_solution(spark):
    r = np.random.default_rng(3)
    for goal in ([0.9, 0.07, 0.03], [0.2, 0.1, 0.7], [0.0, 0.5, 0.5]):
        p = r.dirichlet([0.5, 0.2, 0.1], 300)
        n = r.integers(0, 500, 300)
        soft = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>").repartition(3)
        found = mixing.fit_rates(soft, np.array(goal), ridge=1e-2)
        got = np.array([[*x.p, x.r] for x in soft.select("p", mixing.rate(F.col("p"), found.averages, found.pull).alias("r")).collect()])
        want = {tuple(a): b for a, b in zip(p.tolist(), brute_rates(n, p, np.array(goal), 1e-2))}
        assert found.steps < 40 and (got[:, 3] >= 0).all() and max(abs(x[3] - want[tuple(x[:3])]) for x in got) < 1e-4


def test_mixing_meets_targets(spark, none):
    good = [(k, prose(60) + ".") for k in range(300)]
    bad = [(k, "!! ".join(w.upper() for w in prose(60).split())) for k in range(300, 400)]
    docs = spark.createDataFrame(good + bad + [(500, None), (501, "")], "doc_id long, text string").withColumn("copies_", F.lit(1)).withColumn("dotted.name", F.lit(1)).withColumn("p", F.lit("mine"))
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.9, "junk": 0.1}
    got = mixing.rates(docs, labels, PATH, targets, bits=14).toPandas()
    p, n, r = np.stack(got.p.to_numpy()), got.n_tokens.to_numpy(), got.rate.to_numpy()
    assert n.sum() == sum(len(LIBRARY.encode(t, add_special_tokens=False).ids) for _, t in good + bad)
    assert np.abs((r * n) @ p / n.sum() - [0.9, 0.1]).max() < 0.002 and (r >= 0).all() and len(got) == 402
    assert (np.abs(got.copies - got.rate) <= 1).all()
    mixed = mixing.mix(docs, labels, PATH, targets=targets, bits=14)
    assert mixed.columns == docs.columns and sorted((r.doc_id, r.text or "", r.p) for r in mixed.collect()) == sorted((int(i), t or "", "mine") for i, t, c in zip(got.id, [dict(good + bad).get(i) for i in got.id], got.copies) for _ in range(c))
    assert mixing.rates(none.select("doc_id", "text"), labels, PATH, targets, bits=14, train_on=docs).count() == 0
    with pytest.warns(UserWarning, match="misses its targets"):
        mixing.rates(docs.where("doc_id < 300"), labels, PATH, {"clean": 0.1, "junk": 0.9}, bits=14, train_on=docs)


def test_sample_goes_on_after_a_long_text(spark):
    import pyarrow as pa

    part = lambda ks: pa.RecordBatch.from_pydict({"y": [[k % 2] for k in ks], "text": ["x" * (150 if k == 2 else 30) for k in ks], "at": ks}, pa.schema([("y", pa.list_(pa.int32())), ("text", pa.string()), ("at", pa.int64())]))
    for batches in ([range(9)], [range(3), range(3, 9)], [range(3, 9), range(3)], [[2, 5], [0, 8], [1, 3, 4, 6, 7]]):
        assert quality_classifier.first_bytes([part(list(b)) for b in batches], 100)["at"].to_pylist() == [0, 1], batches
    docs = spark.createDataFrame([(k, "word " * (200_000 if k == 0 else 5)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    chosen = quality_classifier.sample(docs, labels, [F.col("quality")], 100).collect()
    assert len(chosen) > 25 and max(len(r.text) for r in chosen) <= 1 << 18
