"""Exact token counts by prefix dynamic programming.

Each text gets a table of the tokens of every prefix, by character: counts[c] is the number of tokens
of the first c characters as a text of their own. A tokenizer with word ends encodes the words into
which it splits a text apart, so counts[c] = counts[start of the word] + the count of the part word;
part words' counts come from the recurrence of _prefix, one table for each distinct word. No prefix is
ever encoded. White space adds nothing.

Whole counts, truncation to a budget and budget questions are lookups in that table, in Python
(PrefixCounts) or as expressions over the stored column (tokens_at, chars_within, fits).

Texts with signs beyond Latin letters and common marks take the same way if they are composed (NFC,
which every prefix of such a text then is) and their whole count is the library's; the rest - texts
to be composed first, special tokens - and vocabulary files of other kinds have no recurrence: there
the library gives the whole count, and a table, if asked for, encodes their prefixes.

Defined results: a null text counts as empty; an empty text has no tokens; rows are never merged,
so repeated rows each keep their own; null ids stay null; other columns, whatever their names,
are not looked at. Each row is worked on alone and whole, in batches bounded in bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.llm._base import frugal, table
from palimpsest.llm._prefix import Prefixes
from palimpsest.llm._tokens import WordTokens, _PIECE, as_bytes, word_tokens

#: What the library takes for white space, and the pieces of a text of any signs; ASCII's pieces as in _tokens.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTRACTIONS = frozenset("'s 't 're 've 'm 'll 'd".split())


class Parts(dict):
    """word -> the counts of its prefixes by character, as bytes of int32; made when first asked for.
    It forgets all when it holds `most` words, so that a worker's memory stays bounded."""

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        self.made, self.most = Prefixes(path), most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if word in _CONTRACTIONS and len(word) > 2:  # short of its end it is a mark and a letter
            counts = [self.made.counts("'")[0], self.made.counts("'")[0] + self.made.counts(word[1])[0], self.made.counts(word)[-1]]
        else:
            counts = self.made.counts(as_bytes(word))
            if not word.isascii():  # at the ends of characters
                counts = [counts[k - 1] for k in np.cumsum([len(c.encode()) for c in word])]
        self[word] = out = np.array(counts, np.int32).tobytes()
        return out


_parts: dict[str, Parts] = {}


def parts(path: str) -> Parts:
    """One table for each worker and file."""
    if path not in _parts:
        _parts[path] = Parts(path)
    return _parts[path]


class PrefixCounts:
    """The tokens of every prefix of one text, at the places between its characters."""

    def __init__(self, text: str, encoder: WordTokens):
        self.text, self.encoder, self.spread = text, encoder, None
        self.words, self.low = encoder.pieces(text), text
        if self.words is not None:
            self._fill()
            return
        self.whole = len(encoder.library.encode(text, add_special_tokens=False).ids)
        if encoder.apart and "<|" not in text and unicodedata.is_normalized("NFC", text):
            import regex

            low = [c.lower() for c in text]  # sign by sign, as the library does
            self.spread, self.low = np.cumsum([0, *map(len, low)]), "".join(low)
            self.words = regex.findall(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+", self.low)
            whole = self.whole
            self._fill()
            if self.whole != whole:
                self.words, self.whole = None, whole

    def _fill(self) -> None:
        """Counts by the signs that are not white, of which each belongs to one word."""
        get = parts(self.encoder.path).__getitem__
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        part = np.frombuffer(b"".join(map(get, self.words)), np.int32)
        ends = np.cumsum(sizes)
        totals = part[ends - 1] if len(ends) else part
        self.inked = part + np.repeat(np.cumsum(totals) - totals, sizes)
        self.whole = int(self.inked[-1]) if len(part) else 0

    @property
    def total(self) -> int:
        return self.whole

    @cached_property
    def counts(self) -> np.ndarray:
        """counts[c] for c from 0 to the text's length."""
        if self.words is not None:
            signs = np.frombuffer(self.low.encode("utf-32-le"), np.uint32)
            ink = np.ones(len(signs), np.int64)
            for lo, hi in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
                ink[(signs >= lo) & (signs <= hi)] = 0
            out = np.append(0, self.inked)[np.append(0, np.cumsum(ink))].astype(np.int32)
            return out if self.spread is None else out[self.spread]
        encode = lambda x: len(self.encoder.library.encode(x, add_special_tokens=False).ids)
        out, base, start = [0], 0, 0
        for c in range(1, len(self.text) + 1):  # from the last blank on, where the tokenizer splits there
            out.append(base + encode(self.text[start:c]))
            if self.encoder.apart and self.text[c - 1] in " \n":
                base, start = out[-1], c
        return np.array(out, np.int32)

    def over(self, limit: int) -> bool:
        """Whether the whole text takes more than `limit` tokens."""
        return self.whole > limit

    def at(self, chars: int) -> int:
        """Tokens of text[:chars], encoded as a text of its own."""
        return int(self.counts[chars])

    def truncate(self, tokens: int) -> int:
        """The largest number of characters whose prefix takes at most `tokens` tokens."""
        return int(np.flatnonzero(self.counts <= tokens)[-1]) if tokens >= 0 else 0


def tokens_at(counts: Column, chars: Column) -> Column:
    """Tokens of the first `chars` characters, from a stored table; of the whole text beyond its end."""
    return F.get(counts, F.least(chars, F.size(counts) - 1).cast("int"))


def chars_within(counts: Column, tokens: Column) -> Column:
    """The largest number of characters whose prefix takes at most `tokens` tokens, from a stored table."""
    return F.array_max(F.transform(counts, lambda n, c: F.when(n <= tokens, c)))


def fits(counts: Column, tokens: Column) -> Column:
    """Whether the whole text takes at most `tokens` tokens, from a stored table."""
    return F.element_at(counts, -1) <= tokens


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, tables: bool = False) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit and, if asked for, counts, the table of each text: an array of
    int by characters from 0. `path` is the tokenizer file, the same on all executors."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean" + (", counts array<int>" if tables else "")

    def count(batches):
        encoder = word_tokens(path)
        for b in batches:
            n_bytes, n_tokens, over, counts = [], [], [], []
            for text in b.column(1):
                text = text.as_py() or ""
                made = PrefixCounts(text, encoder)
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(made.total)
                over.append(made.over(limit))
                if tables:
                    counts.append(made.counts)
            out = {id_col: b.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "over_limit": pa.array(over, pa.bool_())}
            if tables:
                out |= {"counts": pa.array(counts, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return docs.select(id_col, text_col).mapInArrow(frugal(count, cycles=False), schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


QUERIES: dict[str, Callable] = {"op9_token_counts": op9_token_counts}
ORACLE: dict[str, str] = {}
