"""Each stage of the pipeline against plain Python on the stage's own input, and run() as a whole."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import line_dedup, mixing, quality_classifier

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefgé") for _ in range(R.randint(2, 8))) for _ in range(400)]
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows = []
    for k in range(240):
        text = "\n".join([prose(50), prose(R.randint(20, 300))])
        if k % 3 == 0:
            text = "Subscribe to our letter.\n" + text
        if k % 8 == 7:
            text = "!! ".join(w.upper() for w in text.split())
        rows.append((k, text, "en", f"s{k % 2}"))
    rows += [(300 + k, rows[k][1] + (" tail" if k % 2 else ""), "en", rows[k][3]) for k in range(0, 40)]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, prose(6000), "en", "s1"), (5, rows[5][1], "en", "s1")]
    docs = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k % 8 != 7), int(k % 16 == 3)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def outputs(spark, folder, tmp_path_factory):
    at, read = str(tmp_path_factory.mktemp("stages")), f"{folder}/documents.parquet"
    frames = [spark.read.parquet(read)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(read), folder).write.parquet(read := f"{at}/{k}")
        frames.append(spark.read.parquet(read))
    return frames


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_columns(outputs):
    for f in outputs[1:-1]:
        assert f.dtypes == outputs[0].dtypes


def test_quality(spark, folder, outputs):
    model = quality_classifier.train(outputs[0], spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_classifier.score(outputs[0], model).collect()}
    assert rows(outputs[1]) == Counter({k: n for k, n in rows(outputs[0]).items() if scores[k[0]] >= 0.3})
    kept = {r.doc_id for r in outputs[1].collect()}
    assert all((k in kept) == (k % 8 != 7) for k in range(240))


def test_lines(outputs):
    given = [r for k, n in rows(outputs[1]).items() for r in [k] * n]
    pages, seen = Counter(r[3] for r in given), Counter((r[3], x) for r in given for x in {y.strip(" \t\r\x0b\x0c") for y in (r[1] or "").split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= line_dedup.AMPLE and n > line_dedup.RATIO * pages[k[0]]}
    want = Counter()
    for i, t, lang, source, _ in given:
        t = None if t is None else "\n".join(x for x in t.split("\n") if (source, x.strip(" \t\r\x0b\x0c")) not in gone)
        want[i, t, lang, source, None if t is None else len(t)] += 1
    assert rows(outputs[2]) == want and any("Subscribe" in x for _, x in gone)


def test_near_duplicates(outputs):
    given = rows(outputs[2])
    ids = sorted({k[0] for k in given})
    sets = {}
    for i, t, *_ in given:
        sets.setdefault(i, []).append(five_words(t))
    least = {i: i for i in ids}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    for i in ids:  # ascending, so one pass of joins and one of looking up will do
        for j in ids:
            if j < i and any(alike(a, b) for a in sets[i] for b in sets[j]):
                a, b = least[i], least[j]
                for k in ids:
                    if least[k] in (a, b):
                        least[k] = min(a, b)
    kept = Counter(k[0] for k in rows(outputs[3]).elements())
    assert kept == Counter({i: 1 for i in ids if least[i] == i}) and not rows(outputs[3]) - given


def test_mixing(spark, folder, outputs):
    """Each row as often as the operator's own rates say, and these meet the minimum's conditions, which one solution alone does."""
    given, got = rows(outputs[3]), rows(outputs[4])
    told = mixing.rates(outputs[3], spark.read.parquet(f"{folder}/labels.parquet"), corpus_pipeline.vocabulary(), train_on=outputs[0]).collect()
    texts = {k[0]: k for k in given}
    assert got == Counter(texts[r.id] for r in told for _ in range(r.copies)) and len(told) == given.total()
    n, p, rate = np.array([r.n_tokens for r in told]), np.array([r.p for r in told]), np.array([r.rate for r in told])
    missed = (n * rate) @ p / n.sum() - list(mixing.TARGETS.values())
    assert np.abs(rate - np.maximum(0, 1 - p @ missed / 3e-4)).max() < 1e-3 and abs(missed[0]) < 1e-3


def packed_as(given, got):
    documents = {}
    for r in got:
        documents.setdefault(r.doc_id, []).append(r)
    for i, t in {(k[0], k[1]) for k in given}:
        ids, times = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], sum(n for k, n in given.items() if k[0] == i)
        pieces = documents.pop(i)
        assert sum(r.length for r in pieces) == times * len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert not documents
    sizes = Counter()
    for r in got:
        sizes[r.sequence_id] += r.length
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes.values())


def test_packing_and_run(spark, folder, outputs):
    packed_as(rows(outputs[4]), outputs[5].collect())
    packed_as(rows(outputs[4]), corpus_pipeline.run(spark, folder).collect())


def five_words(text):
    ws = (text or "").lower().split()
    return {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} if ws else set()


def test_near_duplicates_by_similarity(spark):
    r = random.Random(5)
    texts = []
    for _ in range(40):
        base = [r.choice(WORDS) for _ in range(r.randint(30, 300))]
        for edits in (0, 1, 2, 3, 5, 8, 12):
            ws = list(base)
            for _ in range(edits):
                ws[r.randrange(len(ws))] = r.choice(WORDS)
            texts.append(" ".join(ws))
    texts += ["one two", "One  two", "one three"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sets, root = [five_words(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == [i for i, x in enumerate(root) if x == i] and 40 < len(got) < len(texts) - 40


def paged(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t)) for k, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_lines_of_copies_are_no_boilerplate(spark):
    own = "One document, line one.\nOne document, line two."
    docs = paged(spark, [("s", own)] * 60 + [("s", f"Menu\nPage {k}.") for k in range(200)])
    got = Counter(r.text for r in corpus_pipeline.lines(spark, docs, "").collect())
    assert got == Counter({own: 60} | {f"Page {k}.": 1 for k in range(200)})


def test_lines_of_small_sources(spark):
    host = lambda s, pages, n: [(s, f"Menu of {s}\nPage {k} of {s}." if k < n else f"Page {k} of {s}.") for k in range(pages)]
    docs = paged(spark, host("a", 4, 4) + host("b", 40, 6) + host("c", 40, 3) + host("d", 2, 2) + host("e", 300, 14) + host("f", 300, 16))
    got = corpus_pipeline.lines(spark, docs, "").collect()
    assert {r.source for r in got if "Menu" in r.text} == {"c", "d", "e"}


def test_near_duplicates_of_null_and_shared_ids(spark):
    one, two, three, four = (prose(60) for _ in range(4))
    rows = [(None, one), (None, one), (None, two), (7, three), (7, three), (7, four), (7, four), (None, four), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == Counter([(None, one), (None, two), (7, three), (7, four), (None, "")])


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, held_out string, n_lines string, a string, p string, copy string, `dotted.name` string, `tick``name` string"


def odd(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), *"abcdefghi") for i, t, s in rows], ODD)
    return docs.repartition(3) if rows else docs


def test_stages_on_odd_rows_and_names(spark, folder):
    """Nulls, empty and long texts, ties, repeated rows and clashing names: every stage gives what its docstring says."""
    long, own = prose(30000), prose(80)
    given = [(None, None, None), (None, "", "s0"), (1, None, "s0"), (2, own, None), (2, own, None), (2, prose(60), "s1"), (3, own, "s1"), (4, long, "s0"), (None, long, "s0"), (5, " \n\t", "s0"), *((10 + k, f"Menu\n{prose(40)}", "s1") for k in range(8))]
    docs = odd(spark, folder, given)
    own_columns = [*"abcdefghi"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        got = out.collect()
        if name == "packing":
            assert sum(r.length for r in got) == sum(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in given)
            continue
        assert out.dtypes == docs.dtypes and all(list(r)[5:] == own_columns for r in got), name
        texts = Counter((r.doc_id, r.text) for r in got)
        if name == "lines":
            assert len(got) == len(given) and texts == Counter((i, t.replace("Menu\n", "") if t else t) for i, t, _ in given)
        elif name == "near duplicates":
            kept = Counter((i, t) for i, t, _ in given if i is not None and (i >= 10 or i in (2, 4)))
            assert texts == Counter(dict.fromkeys([*kept, (1, None)], 1))
        else:
            assert set(texts) <= {(i, t) for i, t, _ in given}
    none = odd(spark, folder, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_stages_on_bytes_that_are_not_utf8(spark, folder, tmp_path):
    """Such texts, labelled ones too, go through every stage byte by byte; their tokens are those of U+FFFD."""
    given = [(500 + k, prose(60 + k).encode() + bad + prose(20).encode()) for k, bad in enumerate((b" \xff\xfe ", b"\xc3", b" \xed\xa0\x80", b"\xf0\x9f\x98", b" \x80 \xe9t\xe9 "))]
    docs = spark.createDataFrame(given, "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) text", "'en' lang", "'s0' source", "cast(octet_length(text) as long) n_chars")
    at = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").unionByName(docs).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").unionByName(docs.selectExpr("doc_id", "1 quality", "0 toxic")).write.parquet(f"{at}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name == "packing":
            want = {i: len(LIBRARY.encode(t.decode(errors="replace"), add_special_tokens=False).ids) + 1 for i, t in given}
            assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == want
        else:
            got = {(r.doc_id, bytes(r.t)) for r in out.selectExpr("doc_id", "cast(text as binary) t").collect()}
            assert got == set(given) if name in ("lines", "near duplicates") else got <= set(given), name
    told = mixing.rates(docs, spark.read.parquet(f"{at}/labels.parquet"), corpus_pipeline.vocabulary(), train_on=spark.read.parquet(f"{at}/documents.parquet")).collect()
    assert {r.id: r.n_tokens + 1 for r in told} == want


def test_near_duplicates_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", -1)
    test_near_duplicates_of_null_and_shared_ids(spark)
