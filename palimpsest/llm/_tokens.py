"""The tokens of a word-ended BPE, exactly as its library gives them, with each word encoded once."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

from palimpsest.llm._base import lasting, one_thread

#: Texts of these characters alone take the quick way: they are composed already, have no white
#: space beyond ASCII's, and lower-case one to one. All others go through the library whole.
_QUICK = re.compile(r"[^\t-\r\x20-\x7e\xa1-įı-ſ–—‘’“”…]")
#: The same for texts of Latin-1, as a table of bytes to take out: nothing is left of a quick text.
_QUICK_BYTES = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])
_LETTER = "a-zªµºß-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


#: What a tokenizer file must say for words to be encoded apart by the pattern above; any other goes through its library.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def by_words(path: str) -> bool:
    """Whether the file's texts are normalised, split and merged as this module does it."""
    with open(path) as f:
        told = json.load(f)
    steps = lambda k, name: (told.get(k) or {}).get(name)
    model = told.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = all(t["content"].startswith("<|") and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in told.get("added_tokens") or [])
    return steps("normalizer", "normalizers") == _NORMALIZER and steps("pre_tokenizer", "pretokenizers") == [_SPLIT, _BYTE_LEVEL] and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and plain and added


#: The printable characters by which byte-level vocabularies write bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}


def as_bytes(word: str) -> str:
    """A word's bytes as the vocabulary writes them."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


class Kept(dict):
    """word -> what was made of it, kept from the second time on that it is asked for: most words of a
    corpus come once. It forgets all when it holds `most` words, so that a worker's memory stays bounded."""

    #: Marks of words that were asked for. Two words that share one are kept a little early, nothing else.
    MARKS = 1 << 22

    def __init__(self, model, most: int = 500_000):
        super().__init__()
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.asked = bytearray(self.MARKS)

    def keep(self, word: str, made):
        at = hash(word) & self.MARKS - 1
        if self.asked[at]:
            if len(self) >= self.most:
                self.forget()
            self[word] = made
        else:
            self.asked[at] = 1
        return made


class Words(Kept):
    """word -> its ids as bytes of little-endian numbers."""

    def __init__(self, model, kind: str, most: int = 500_000):
        super().__init__(model, most)
        self.kind = kind

    def __missing__(self, word: str) -> bytes:
        return self.keep(word, array(self.kind, [t.id for t in self.model.tokenize(as_bytes(word))]).tobytes())


class Sizes(Kept):
    """word -> the number of its ids."""

    def __missing__(self, word: str) -> int:
        return self.keep(word, len(self.model.tokenize(as_bytes(word))))


class WordTokens:
    """Encoder for a vocabulary file of the tokenizers library: word by word if the file splits texts
    by the word pattern above, whole by the library if not. Words are kept for ids or for counts, not
    for both: a worker that counted for one stage and encodes for the next would hold them twice."""

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer

        self.path, self.apart = path, by_words(path)
        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.words = Words(self.library.model, "HI"[self.width > 2])
        self.sizes = Sizes(self.library.model)

    def pieces(self, text: str) -> list[str] | None:
        """The words to encode apart, or None if only the library may split this text."""
        if not self.apart or "<|" in text:
            return None
        try:
            slow = text.encode("latin-1").translate(None, _QUICK_BYTES)
        except UnicodeEncodeError:
            slow = _QUICK.search(text)
        if slow:
            return None
        return _PIECE.findall(text.lower())

    def raw(self, text: str) -> bytes:
        """The ids of the whole text as little-endian numbers of `width` bytes."""
        ws = self.pieces(text)
        if ws is None:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if self.sizes:
            self.sizes.forget()
        return b"".join(map(self.words.__getitem__, ws))

    def count(self, text: str) -> int:
        """The number of ids of the whole text."""
        ws = self.pieces(text)
        if ws is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.words:
            self.words.forget()
        return sum(map(self.sizes.__getitem__, ws))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), self.kind)


_made: dict[str, WordTokens] = lasting({})


def word_tokens(path: str) -> WordTokens:
    """One encoder for each worker and file, until a stage without words comes."""
    if path not in _made:
        _made[path] = WordTokens(path)
    return _made[path]
