"""The Mac's script encodings: decoding, names, fonts, and which of them a file's strings are in.

The single-byte tables are those of Python's codecs. Python has no Mac tables for Hebrew, Thai,
Arabic and Farsi's neighbours in full, nor for Japanese, Chinese and Korean with Apple's extra rows:
these are approximated by the nearest standard set (APPROXIMATE), which the common characters share.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

ROMAN = "Mac Roman"
#: name -> (short name, script code, codec, double-byte)
ENCODINGS = {
    ROMAN: ("roman", 0, "mac_roman", False),
    "Mac Japanese": ("japanese", 1, "shift_jis", True),
    "Mac Chinese Simplified": ("chinese-simplified", 25, "gb2312", True),
    "Mac Chinese Traditional": ("chinese-traditional", 2, "big5", True),
    "Mac Korean": ("korean", 3, "euc_kr", True),
    "Mac Arabic": ("arabic", 4, "mac_arabic", False),
    "Mac Farsi": ("farsi", None, "mac_farsi", False),
    "Mac Hebrew": ("hebrew", 5, "iso8859_8", False),
    "Mac Cyrillic": ("cyrillic", 7, "mac_cyrillic", False),
    "Mac Greek": ("greek", None, "mac_greek", False),
    "Mac Thai": ("thai", 21, "iso8859_11", False),
    "Mac Central European": ("central-european", 29, "mac_latin2", False),
    "Mac Turkish": ("turkish", None, "mac_turkish", False),
    "Mac Icelandic": ("icelandic", None, "mac_iceland", False),
    "Mac Croatian": ("croatian", None, "mac_croatian", False),
    "Mac Romanian": ("romanian", None, "mac_romanian", False),
}
APPROXIMATE = frozenset({"Mac Japanese", "Mac Chinese Simplified", "Mac Chinese Traditional", "Mac Korean", "Mac Hebrew", "Mac Thai"})
MARGIN = 3
#: Those that compete where no fonts are known, the first winning ties.
CONTEST = ["Mac Japanese", "Mac Korean", "Mac Chinese Simplified", "Mac Chinese Traditional", "Mac Cyrillic", "Mac Central European", "Mac Turkish", "Mac Hebrew", "Mac Arabic", "Mac Icelandic", "Mac Croatian", "Mac Romanian"]
LATIN = frozenset({ROMAN, "Mac Central European", "Mac Turkish", "Mac Icelandic", "Mac Croatian", "Mac Romanian"})
_MARKS = frozenset("¢£¥§¶©®°¬±·«»‘’“”•–—…™")


def codec(name: str) -> str:
    return ENCODINGS[name][2]


def by_name(name: str) -> str | None:
    """An encoding by its short or full name, whatever the case, spaces, hyphens and a leading mac."""

    def plain(s: str) -> str:
        return re.sub(r"[ _-]", "", s.lower()).removeprefix("mac")

    return next((full for full, (short, *_) in ENCODINGS.items() if plain(name) in (plain(short), plain(full))), None)


def by_script(code: int) -> str | None:
    return next((full for full, (_, script, *_) in ENCODINGS.items() if script == code), None)


@cache
def single(name: str) -> tuple[str, ...]:
    """The characters of the bytes 0x80 to 0xFF, empty where there is none."""
    out = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(codec(name)))
        except UnicodeDecodeError:
            out.append("")
    return tuple(out)


def units(b: bytes, name: str) -> list[tuple[str, int]]:
    """Characters with their codes, of one byte or two; U+FFFD for a byte that has none."""
    if not ENCODINGS[name][3]:
        table = single(name)
        return [(chr(c) if c < 0x80 else table[c - 0x80] or "�", c) for c in b]
    out, at = [], 0
    while at < len(b):
        for size in (2, 1) if b[at] >= 0x80 and at + 1 < len(b) else (1,):
            try:
                c = b[at : at + size].decode(codec(name))
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                out.append((c, int.from_bytes(b[at : at + size], "big")))
                break
        else:
            size = 1
            out.append(("�", b[at]))
        at += size
    return out


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def decode(b: bytes, name: str, mixed: bool = True) -> str | None:
    """The text, or None if a byte has no character. mixed: of Japanese, a half-width letter alone
    beside a Latin one is read as Mac Roman, as in haven’t."""
    if name == ROMAN:
        return b.decode("mac_roman")
    found = units(b, name)
    if any(c == "�" for c, _ in found):
        return None
    out = []
    for k, (c, code) in enumerate(found):
        before = found[k - 1] if k else ("", 0)
        after = found[k + 1] if k + 1 < len(found) else ("", 0)
        half = lambda u: 0xA1 <= u[1] <= 0xDF
        if mixed and name == "Mac Japanese" and 0xA6 <= code <= 0xDD and not half(before) and not half(after) and (_alnum(before[0]) or _alnum(after[0])):
            c = bytes([code]).decode("mac_roman")
        out.append(c)
    return "".join(out)


def decode_or_roman(b: bytes, name: str) -> str:
    found = decode(b, name)
    return b.decode("mac_roman") if found is None else found


def encode_roman(s: str) -> bytes | None:
    try:
        return s.encode("mac_roman")
    except UnicodeEncodeError:
        return None


_FONTS = {
    "Mac Japanese": "Chu Gothic|Hei Mincho|Kyoto|Osaka|Sapporo".split("|"),
    "Mac Chinese Simplified": "Beijing|Fang Song|Hei|Kai|Song".split("|"),
    "Mac Chinese Traditional": "Apple LiGothic|Apple LiSung|Taipei".split("|"),
    "Mac Korean": "AppleGothic|AppleMyungjo|Seoul".split("|"),
}


def for_font(ident: int, name: bytes) -> str | None:
    """The encoding of a font's text, if its name shows one, or its id does and its name fits."""
    spelt = name.decode("latin-1").lstrip(".*")
    for encoding, starts in _FONTS.items():
        for s in starts:
            if spelt.startswith(s) and not spelt[len(s) : len(s) + 1].isalpha():
                return encoding
    if spelt.endswith(" CE"):
        return "Mac Central European"
    if spelt.endswith(" CY"):
        return "Mac Cyrillic"
    own = by_script((ident - 16384) // 512 + 1) if 16384 <= ident <= 32767 else None
    return own if own and not name.isascii() and decode(name, own) is not None else None


def _half(c: str) -> bool:
    return "ｦ" <= c <= "ﾝ"


def _ideograph(c: str) -> bool:
    return "一" <= c <= "鿿"


def _score_double(name: str, texts: list[bytes], hinted: bool) -> int:
    strong = against = fails = foreign = 0
    for t in texts:
        if t.isascii():
            continue
        foreign += 1
        s = decode(t, name, mixed=False)
        if s is None:
            fails += 1
            continue
        at = lambda k: s[k] if 0 <= k < len(s) else ""  # noqa: B023, E731
        for k, c in enumerate(s):
            before, after = at(k - 1), at(k + 1)
            if _ideograph(c) and _letter(before or " ") and _letter(after or " "):
                against += 1
            elif _half(c):
                alone = not _half(before) and not _half(after)
                goes_on = c == "ﾂ" and after in ("", "\r")
                against += alone and not goes_on and (_alnum(before) or _alnum(after))
            elif name == "Mac Japanese":
                strong += "ぁ" <= c <= "ヿ"
            elif name == "Mac Korean":
                strong += "가" <= c <= "힣"
            else:
                strong += _ideograph(c) and (before >= "　" or after >= "　")
    least, most = (2, foreign) if hinted else (4, foreign // 10)
    return 0 if strong < least or strong <= 2 * against or fails > most else strong


def _score_single(texts: list[bytes]) -> int:
    lengths = [len(r) for t in texts for r in re.findall(rb"[\x80-\xff]+", t)]
    long = sum(n >= 3 for n in lengths)
    return long if long >= 2 and long > len(lengths) - long else 0


@cache
def _alphabet(c: str) -> str:
    first = unicodedata.name(c, "").split(" ")[0]
    return first if first in ("LATIN", "CYRILLIC", "GREEK", "HEBREW", "ARABIC", "THAI") else ""


def verdicts(name: str, s: list[str]) -> list[int]:
    """For each character: 1 if it fits the encoding, -1 if it doesn't, 0 if it shows nothing."""
    out = [0] * len(s)
    at = lambda k: s[k] if 0 <= k < len(s) else " "
    k = 0
    while k < len(s):
        if s[k] < "\x80":
            k += 1
            continue
        end = k
        while end < len(s) and s[end] >= "\x80":
            end += 1
        run = s[k:end]
        same = len(set(run)) == 1
        letters = all(c.isalpha() for c in run)
        for j in range(k, end):
            c, before, after = s[j], at(j - 1), at(j + 1)
            odd = any(x != c and x not in _MARKS for x in run)
            is_letter = c.isalpha() and c not in "ﬁﬂ"
            if same and len(run) > 1:
                continue
            if name in LATIN and odd and (len(run) > 3 or len(run) == 3 and not letters):
                out[j] = -1
            elif before.isalpha() or after.isalpha():
                if is_letter:
                    mixed = any(x.isalpha() and _alphabet(x) != _alphabet(c) for x in (before, after))
                    capital_inside = before.isalpha() and before.islower() and c.isupper()
                    small_after = c.islower() and before.isupper() and at(j - 2).isupper() and j > 1
                    starts_badly = not before.isalpha() and c in "ъьы"
                    out[j] = -1 if mixed or capital_inside or small_after or starts_badly else 1
                else:
                    out[j] = 1 if c in _MARKS else -1
        k = end
    return out


def _read(name: str, b: bytes) -> list[str]:
    if name == ROMAN:
        return list(b.decode("mac_roman"))
    table = single(name)
    out = []
    for c in b:
        s = chr(c) if c < 0x80 else (table[c - 0x80] or "�")[0]
        out.append("￼" if c >= 0x80 and s < "\x80" and s != " " and not s.isdigit() else s)
    return out


def _is_data(b: bytes) -> bool:
    return re.search(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]", b) is not None


def evidence(name: str, texts: list[bytes]) -> int:
    """Characters that fit less those that don't, double-byte ones twice."""
    net = 0
    for t in texts:
        if t.isascii() or _is_data(t):
            continue
        if not ENCODINGS[name][3]:
            net += sum(verdicts(name, _read(name, t)))
            continue
        u = units(t, name)
        wide = lambda k: 0 <= k < len(u) and u[k][1] > 0xFF  # noqa: B023, E731
        at = lambda k: u[k][0] if 0 <= k < len(u) else ""  # noqa: B023, E731
        for k, (c, code) in enumerate(u):
            lead, beside = code >> 8, wide(k - 1) or wide(k + 1)
            if c < "\x80" or c in (at(k - 1), at(k + 1)):
                continue
            if code > 0xFF and code & 0xFF < 0x80 and _letter(at(k - 1)):
                net -= 2
            elif c == "�":
                net -= 1
            elif _half(c) and not beside:
                net -= 1
            elif _ideograph(c) and _letter(at(k - 1)) and _letter(at(k + 1)):
                net -= 2
            elif "Chinese" in name and wide(k) and at(k + 1) == " " and wide(k + 2):
                net -= 2
            elif name == "Mac Japanese" and 0x88 <= lead <= 0x98 and beside:
                net += 1
            elif (
                name == "Mac Japanese" and ("ぁ" <= c <= "ヿ" or c == "　") or name == "Mac Korean" and "가" <= c <= "힣"
                or name == "Mac Chinese Simplified" and 0xB0 <= lead <= 0xD7 and beside or name == "Mac Chinese Traditional" and 0xA4 <= lead <= 0xC6 and beside
            ):
                net += 2
    return net


def _beats_roman(name: str, texts: list[bytes]) -> bool:
    ahead = n = 0
    for t in texts:
        if t.isascii() or _is_data(t):
            continue
        own, roman = _read(name, t), _read(ROMAN, t)
        for a, b, x, y in zip(own, roman, verdicts(name, own), verdicts(ROMAN, roman)):
            if a != b:
                n += 1
                ahead += x - y
    return ahead >= MARGIN and 2 * ahead >= n


def detect(texts: list[bytes], fonts: list[str] | None = None) -> str:
    """The encoding of a file's strings. fonts: the encodings that its fonts show; None if it lists none."""
    hints = [f for f in fonts or [] if f and f != ROMAN]
    best, most = ROMAN, 0
    for name in dict.fromkeys(["Mac Japanese", *hints]):
        hinted = name in hints
        if ENCODINGS[name][3]:
            got = _score_double(name, texts, hinted)
        else:
            got = _score_single(texts) if hinted and name != "Mac Central European" else 0
        if got > most:
            best, most = name, got
    if best != ROMAN or fonts is not None:
        return best
    most = max(evidence(ROMAN, texts), 0) + MARGIN
    for name in CONTEST:
        if (ENCODINGS[name][3] or _beats_roman(name, texts)) and (got := evidence(name, texts)) > most:
            best, most = name, got
    return best


def wide_in_word(s: str) -> bool:
    """Wide characters inside an ASCII word, as Roman text read in a double-byte encoding has."""
    return re.search(r"[A-Za-z][　-\U0010ffff]+[A-Za-z]", s) is not None
