"""Lexical retrieval packing: BM25 neighbours fill the window of each seed document.

1. Every text is encoded once and written to the shared folder as its ids.
2. Document frequencies of all ids and the mean length are counted over the whole corpus: one
   row for each id of the vocabulary, so at most its size, whatever the input.
3. Each shard - the documents of one partition, at most `shard_tokens` tokens at a time - gets an
   inverted index with the corpus' statistics. A seed is the rest of a cut document, else the
   next unused document; the unused documents that match it best by BM25 fill its window, then
   unused documents that share no id with it. The last one is cut at the window's end and its
   rest seeds the next window. Documents longer than a window fill windows of their own first.
   What is left at a shard's end is cut at powers of two, so no sequence needs padding.

Nothing is shuffled but the frequencies, so a hot source weighs on no task, and a lost executor
costs the rerun of its own partitions, which read the written ids in the same order.

Defined results: a null text counts as empty and has the end id alone; bytes that are not UTF-8 are
encoded as U+FFFD; null ids stay null; repeated rows are packed each for itself; an empty table
gives no rows; the order of ties in BM25 is that of the rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm._base import as_text, cut, frugal, sliced, small_batches, table
from palimpsest.llm._tokens import word_tokens

K1, B = 1.2, 0.75


def encode(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id and ids, little-endian unsigned 32-bit or, where the vocabulary allows, 16-bit numbers."""

    def go(batches):
        encoder = word_tokens(path)
        last = np.array([end_id], encoder.kind).tobytes()
        for b in sliced(batches):
            ids = pa.array([encoder.raw(as_text(x)) + last for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(frugal(go, cycles=False), f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids binary")


class Shard:
    """Documents as ids, and their inverted index with BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, self.n = docs, len(docs)
        sizes = np.array([len(d) for d in docs], np.int64)
        key = np.concatenate(docs).astype(np.int64)  # in place: a shard's keys are the most that a worker holds
        key *= self.n
        key += np.repeat(np.arange(self.n), sizes)
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(first, len(key)))
        term, self.doc = key[first] // self.n, (key[first] % self.n).astype(np.int32)
        norm = K1 * (1 - B + B * sizes / max(mean, 1))
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.start = np.searchsorted(term, np.arange(len(idf) + 1))

    def neighbours(self, seed: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share an id with the seed, best first."""
        terms = np.flatnonzero(np.bincount(seed, minlength=1))
        lo, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[~unused] = 0
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length). All but those of the last, which have
    powers of two for lengths, fill the window."""
    shard = Shard(docs, idf, mean)
    unused = np.ones(shard.n, bool)
    pending: tuple[int, int] | None = None
    left, turn = int(sum(len(d) for d in docs)), 0
    while left:
        if pending is None:
            while not unused[turn]:
                turn += 1
            pending = (turn, 0)
            unused[turn] = False
        row, room = [], window
        seed = pending

        def take(doc: int, start: int) -> None:
            nonlocal room, pending
            n = min(room, len(docs[doc]) - start)
            row.append((doc, start, n))
            room -= n
            pending = (doc, start + n) if start + n < len(docs[doc]) else None

        take(*seed)
        if room and unused.any():
            for doc in shard.neighbours(docs[seed[0]][seed[1] :][:window], unused):
                unused[doc] = False
                take(int(doc), 0)
                if not room:
                    break
        while room and unused[turn:].any():  # nothing left shares an id with the seed
            while not unused[turn]:
                turn += 1
            unused[turn] = False
            take(turn, 0)
        left -= window - room
        if not room:
            yield row
            continue
        total, at = window - room, 0  # the last: cut at powers of two
        flat = list(row)
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            want, part = 1 << bit, []
            while want:
                d, s, n = flat[at]
                m = min(n, want)
                part.append((d, s, m))
                want -= m
                flat[at] = (d, s + m, n - m)
                at += m == n
            yield part


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, shard_tokens: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    asked for, the piece's ids."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    kind, vocabulary = word_tokens(path).kind, max(word_tokens(path).library.get_vocab_size(), end_id + 1)
    with small_batches(docs.sparkSession):
        coded = cut(encode(docs, path, end_id, id_col, text_col), "ids")

    def frequencies(batches):
        df, n, tokens = np.zeros(vocabulary, np.int64), 0, 0
        for b in batches:
            for x in b.column(0):
                a = np.frombuffer(x.as_py(), kind)
                df[a] += 1  # once, however often an id comes in a
                n, tokens = n + 1, tokens + len(a)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, tokens]))], ["term", "n"])

    rows = coded.select("ids").mapInArrow(frugal(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counted = {r["term"]: r["n"] for r in rows}
    n_docs, n_tokens = counted.pop(-1, 0), counted.pop(-2, 0)
    mean = n_tokens / max(n_docs, 1)
    df = np.zeros(vocabulary)
    for term, n in counted.items():
        df[term] = n
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)

    id_kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {id_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")

    def go(batches):
        following = TaskContext.get().partitionId() << 33
        names, held, size = [], [], 0

        def flush():
            nonlocal following
            cols = [[] for _ in range(7 + with_ids)]
            for pieces in pack(held, idf, mean, window) if held else ():
                offset = 0
                for d, s, n in pieces:
                    ids = held[d][s : s + n]
                    for c, v in zip(cols, (names[d], s, n, zlib.crc32(ids.astype("<u4").tobytes()), len(held[d]), following, offset, ids)):
                        c.append(v)
                    offset += n
                following += 1
            t = [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:7]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[7:]]
            return pa.RecordBatch.from_arrays(t, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids])

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for name, x in zip(b.column(0), b.column(1)):
                names.append(name.as_py())
                held.append(np.frombuffer(x.as_py(), kind))
                size += len(held[-1])
                if size >= shard_tokens:
                    yield flush()
                    names, held, size = [], [], 0
        if held:
            yield flush()

    return coded.mapInArrow(frugal(go), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable] = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
