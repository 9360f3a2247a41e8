"""Token counts of every prefix of a word, by dynamic programming over a vocabulary of merges.

The encoding of a text's prefix is a prefix's encoding and one more token: of the tokens that end at
a place, exactly one may follow the encoding up to where it starts, and that one is told by the two
tokens alone (merging their signs gives the two again). So last[i], the last token of the first i
signs, gives count[i] = count[i - len(last[i])] + 1, each place once and without encoding any prefix.
A prefix that ends a word has the end mark on its last sign, whose tokens are tried the same way.
"""

from __future__ import annotations

import json
from array import array

END = "</w>"


class Prefixes:
    """Counts by the merges of a vocabulary file with word ends."""

    def __init__(self, path: str, most: int = 400_000):
        with open(path) as f:
            model = json.load(f)["model"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        inner = [t for t in model["vocab"] if not t.endswith(END)]
        final = [t[: -len(END)] for t in model["vocab"] if t.endswith(END) and t != END]
        self.signs = sorted({*inner, *final})
        # every end of a token -> 0, or the token's number from 1 times 4, plus 1 within a word, 2 at its end
        self.tails = {t[k:]: 0 for t in self.signs for k in range(len(t))}
        number = {t: k for k, t in enumerate(self.signs, 1)}
        for ts, flag in ((inner, 1), (final, 2)):
            for t in ts:
                self.tails[t] = 4 * number[t] | self.tails[t] & 3 | flag
        self.told: dict[int, bool] = {}
        self.most = most

    def merged(self, signs: list[str]) -> list[str]:
        """Merges the pair of least rank, the leftmost of equals, until there is none."""
        while len(signs) > 1:
            least, at = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(signs, signs[1:])))
            if least == 1 << 60:
                break
            signs = [*signs[:at], signs[at] + signs[at + 1], *signs[at + 2 :]]
        return signs

    def follows(self, before: int, token: int, ends: bool) -> bool:
        """Whether the encoding of two tokens' signs is the two tokens. ends: the second ends the word."""
        first, second = self.signs[before - 1], self.signs[token - 1]
        signs = [*first, *second]
        if ends:
            signs[-1] += END
        if len(self.told) >= self.most:
            self.told.clear()
        return self.merged(signs) == [first, second + END if ends else second]

    def counts(self, shown: str) -> array:
        """For each i from 1, the tokens of the first i signs as a word of their own."""
        count, last, out = [0], [0], array("i")
        tails, told = self.tails.get, self.told
        for i in range(1, len(shown) + 1):
            found, k = [], i - 1
            while k >= 0 and (v := tails(shown[k:i])) is not None:
                if v:
                    found.append((k, v))
                k -= 1
            here = end = token = 0
            for k, v in reversed(found):  # the longest is mostly the one
                t = v >> 2
                for flag in (1, 2):
                    if not v & flag or (end if flag == 2 else here):
                        continue
                    if k:
                        key = (last[k] << 18 | t) << 1 | (flag == 2)
                        ok = told.get(key)
                        if ok is None:
                            ok = told[key] = self.follows(last[k], t, flag == 2)
                        if not ok:
                            continue
                    if flag == 2:
                        end = count[k] + 1
                    else:
                        here, token = count[k] + 1, t
                if here and end:
                    break
            count.append(here)
            last.append(token)
            out.append(end)
        return out
