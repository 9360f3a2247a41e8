"""Card stacks: blocks, backgrounds, cards, their parts and texts, and the listings of both.

Text is read twice if need be: once as Mac Roman, which gathers all strings and the fonts' encodings,
and again in the encoding that these show. Runs of field text follow their own fonts."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from palimpsest.functions.encodings import ROMAN, decode, decode_or_roman, detect, for_font, wide_in_word
from palimpsest.functions.forks import resources, roman

KINDS = frozenset("STAK MAST LIST PAGE BKGD CARD BMAP STBL FTBL PRNT PRST PRFT FREE TAIL".split())
_SHOWN = str.maketrans({"\x11": "⌘", "\x12": "✓", "\x13": "◆", "\x14": ""})


@dataclass(frozen=True)
class Form:
    """Where a generation of stacks keeps its fields."""

    order: str = ">"
    back: int = 0  # how many bytes earlier than in 2.x a layer's later fields are
    script: int = 0x600
    background_parts: int = 36
    name: int = 30
    gap: int = 0  # between a name and its script
    pages: int = 48
    entries: int = 24
    zero_ended: bool = False  # field text: an id and text up to a zero
    colours: bool = False

    def int4(self, b: bytes, at: int) -> int:
        return struct.unpack_from(self.order + "i", b, at)[0]

    def int2(self, b: bytes, at: int) -> int:
        return struct.unpack_from(self.order + "h", b, at)[0]


NEW = Form()
OLD = Form(back=4, background_parts=32, entries=20, zero_ended=True)
IIGS = Form(order="<", back=4, script=0x604, name=42, gap=4, pages=40, zero_ended=True, colours=True)


@dataclass
class Script:
    text: str = ""
    language: str = ""
    compiled: bytes = b""


@dataclass
class PartRow:
    ident: int
    kind: str
    name: str
    script: Script
    font: int = -1


@dataclass
class Layer:
    kind: str
    ident: int
    name: str = ""
    script: Script = field(default_factory=Script)
    parts: list[PartRow] = field(default_factory=list)
    texts: list[tuple[PartRow | None, str, bool]] = field(default_factory=list)  # part, text, of the background
    background: int | None = None

    @property
    def label(self) -> str:
        return label(self.kind, self.name, self.ident)

    def part(self, ident: int) -> PartRow | None:
        return next((p for p in self.parts if p.ident == ident), None)


@dataclass
class Stack:
    version: int
    script: Script
    backgrounds: list[Layer]
    cards: list[Layer]
    externals: list[tuple[str, str]] = field(default_factory=list)
    told_cards: int | None = None


class NotAStack(ValueError):
    pass


def label(kind: str, name: str, ident: int) -> str:
    return f'{kind} "{name}"' if name else f"{kind} id {ident}"


def _zero(b: bytes) -> bytes:
    return b.partition(b"\0")[0]


class Reading:
    """How a stack's text is decoded: its encoding, whether that is forced on all of it, its fonts'
    encodings and its styles' fonts. Keeps the bytes of all strings."""

    def __init__(self, encoding: str = ROMAN, forced: bool = False):
        self.encoding, self.forced = encoding, forced
        self.kept: list[bytes] = []
        self.fonts: dict[int, str] = {}
        self.shown: list[str] = []  # encodings that are not Roman, as the fonts come
        self.styles: dict[int, int] = {}

    def text(self, b: bytes) -> str:
        self.kept.append(b)
        return decode_or_roman(b, self.encoding).translate(_SHOWN)

    def source(self, b: bytes) -> str:
        """A script's lines. The sign that continues one is the byte of ¬ in every encoding."""
        if self.encoding == ROMAN:
            return self.text(b).replace("\r", "\n")
        return "\n".join(self.text(x[:-1]) + "¬" if x.endswith(b"\xc2") else self.text(x) for x in b.split(b"\r"))

    def script(self, b: bytes) -> Script:
        """Text up to a zero, or, after a zero, a script of another language with a header of its own."""
        if len(b) < 21 or b[:5] != b"\0WOSA":
            return Script(self.source(_zero(b)))
        head, size = struct.unpack_from(">II", b, 5)
        if 1 + head > len(b):
            return Script()
        data = b[1 + head : 1 + head + size]
        language = "AppleScript" if b[13:17] == b"ascr" else roman(b[13:17])
        if b[17:21] == b"scpt":
            return Script("", language, data)
        return Script(self.source(data), language)

    def font_table(self, b: bytes, f: Form) -> None:
        """Ids and zero-ended names, each filled up to an even length. Ids 0 and 1 follow the system,
        those from 16384 on may have been given to any font: only a known name tells their encoding."""
        left = f.int4(b, 16) if len(b) >= 24 else 0
        at = 24
        while left > 0 and at + 3 <= len(b):
            ident, name = f.int2(b, at), _zero(b[at + 2 :])
            at += 3 + len(name)
            at += at & 1
            left -= 1
            if told := for_font(ident, name):
                self.shown.append(told)
                self.fonts[ident] = told
            elif 2 <= ident < 16384:
                self.fonts[ident] = ROMAN

    def style_table(self, b: bytes, f: Form) -> None:
        count = f.int4(b, 16) if len(b) >= 24 else 0
        for at in range(24, min(24 + 24 * max(count, 0), len(b) - 23), 24):
            self.styles[f.int4(b, at)] = f.int2(b, at + 12)

    def run(self, b: bytes, font: int) -> str:
        own = self.fonts.get(font)
        if own is None or self.forced:
            return decode_or_roman(b, self.encoding)
        if own != ROMAN or self.encoding == ROMAN:
            return decode_or_roman(b, own)
        found = decode(b, self.encoding)
        return found if found is not None and not wide_in_word(found) else roman(b)

    def field_text(self, b: bytes, font: int) -> str:
        """Past a zero, or past a table of style runs, whose length has its high bit set. A run that
        begins no later than one before it is left from an edit and doesn't count."""
        runs: list[tuple[int, int]] = []
        skip = 1
        if len(b) > 1 and b[0] & 0x80:
            skip = min(struct.unpack_from(">H", b)[0] & 0x7FFF, len(b))
            for at in range(2, skip - 3, 4):
                start, style = struct.unpack_from(">HH", b, at)
                if not runs or start > runs[-1][0]:
                    own = self.styles.get(style, -1)
                    runs.append((start, font if own == -1 else own))
        if not runs or runs[0][0] > 0:
            runs.insert(0, (0, font))
        b = b[skip:].rstrip(b"\0")
        self.kept.append(b)
        ends = [start for start, _ in runs[1:]] + [len(b)]
        return "".join(self.run(b[start:end], own).translate(_SHOWN) for (start, own), end in zip(runs, ends) if start < min(end, len(b)))


def blocks(b: bytes, f: Form) -> list[tuple[str, int, bytes]]:
    """Kind, id and bytes of all blocks, damaged parts passed over at steps of 32 bytes. Of blocks of
    equal kind and id the last counts before any damage, the first after."""
    out: dict[tuple[str, int, int], tuple[str, int, bytes]] = {}
    known: dict[tuple[str, int], int] = {}
    at, damaged = 0, False
    while at + 12 <= len(b):
        size = f.int4(b, at) & 0x3FFFFFFF
        kind = roman(b[at + 4 : at + 8])
        if size < 12 or at + size > len(b) or damaged and kind not in KINDS:
            if at == 0:
                break
            damaged = True
            at = (at + 32) // 32 * 32
            continue
        key = (kind, f.int4(b, at + 8))
        if key not in known or not damaged:
            known[key] = at
            out[*key, at] = (*key, b[at : at + size])
        at += size
        if kind == "TAIL":
            break
    return list(out.values())


def _fill(layer: Layer, b: bytes, at: int, f: Form, background: Layer | None, read: Reading) -> None:
    if at + 14 > len(b):
        return
    n_parts, _, part_bytes, n_texts, text_bytes = struct.unpack_from(f.order + "HHIHI", b, at)
    here = at + 14
    parts_end = here + part_bytes
    for _ in range(n_parts):
        if here + f.name > len(b) or here >= parts_end:
            break
        size = f.int2(b, here) & 0xFFFF
        if size < f.name or here + size > len(b):
            break
        p = b[here : here + size]
        kind = p[4] & 15 if f.colours else p[4]
        name = _zero(p[f.name :])
        rest = p[f.name + len(name) + 2 + f.gap :]
        layer.parts.append(PartRow(f.int2(p, 2) & 0xFFFF, {1: "button", 2: "field"}.get(kind, "part"), read.text(name).replace("\r", "\n"), read.script(rest) if rest else Script(), -1 if f.zero_ended else f.int2(p, 24)))
        here += size
    here = min(parts_end, len(b))
    texts_end = min(here + text_bytes, len(b))
    found: list[tuple[int, str]] = []
    for _ in range(n_texts):
        if f.zero_ended:
            if here + 2 > texts_end:
                break
            raw = _zero(b[here + 2 : texts_end])
            found.append((f.int2(b, here), read.text(raw)))
            here += 3 + len(raw)
        else:
            if here + 4 > texts_end:
                break
            ident, size = f.int2(b, here), f.int2(b, here + 2) & 0xFFFF
            if here + 4 + size > len(b):
                break
            owner = layer if ident < 0 or background is None else background
            p = owner.part(abs(ident))
            found.append((ident, read.field_text(b[here + 4 : here + 4 + size], p.font if p else -1)))
            here += 4 + size + size % 2
    for ident, t in found:
        if layer.kind == "background":
            layer.texts.append((layer.part(ident), t, True))
        elif ident < 0:
            layer.texts.append((layer.part(-ident), t, False))
        else:
            own = background.part(ident) if background else None
            if own is None or own.kind != "button":  # a button's entry is its state on this card
                layer.texts.append((own, t, own is not None))
    here = texts_end + 32 * bool(f.colours and len(b) >= 18 and f.int2(b, 16) & 0x0400)
    if here < len(b):
        name = _zero(b[here:])
        layer.name = read.text(name)
        rest = b[here + len(name) + 1 + f.gap :]
        layer.script = read.script(rest) if rest else Script()


def parse(data: bytes, rsrc: bytes = b"", encoding: str | None = None) -> Stack:
    """A stack; with an encoding, all of its text in that, whatever its fonts."""
    if encoding:
        return _parse(data, rsrc, Reading(encoding, forced=True))
    first = Reading()
    made = _parse(data, rsrc, first)
    # fonts and kana alone count: signs for decoration would read as anything
    found = detect(first.kept, first.shown)
    return made if found == ROMAN else _parse(data, rsrc, Reading(found))


def _parse(data: bytes, rsrc: bytes, read: Reading) -> Stack:
    if len(data) < 20 or data[4:8] != b"STAK":
        raise NotAStack("no stack")
    f = NEW
    if struct.unpack_from("<I", data, 16)[0] < 0x100 <= struct.unpack_from(">I", data, 16)[0]:
        f = IIGS
    found = blocks(data, f)
    if not found or found[0][0] != "STAK":
        raise NotAStack("no stack block")
    head = found[0][2]
    if len(head) < 56:
        raise NotAStack("the stack block is too short")
    version = f.int4(head, 16)
    if f is NEW and version < 10:
        f = OLD
    for kind, _, b in found:
        if kind == "FTBL":
            read.font_table(b, f)
        elif kind == "STBL":
            read.style_table(b, f)
    by: dict[str, dict[int, bytes]] = {}
    for kind, ident, b in found:
        by.setdefault(kind, {})[ident] = b
    bkgd, cards, pages = by.get("BKGD", {}), by.get("CARD", {}), by.get("PAGE", {})

    chain: list[int] = []
    nxt = f.int4(head, 40)
    while nxt in bkgd and nxt not in chain and len(bkgd[nxt]) >= 32:
        chain.append(nxt)
        nxt = f.int4(bkgd[nxt], 28 - f.back)
    if len(chain) < len(bkgd):  # a broken chain: as they come in the file
        chain = [i for k, i, _ in found if k == "BKGD"]
    made: dict[int, Layer] = {}
    for ident in chain:
        made[ident] = Layer("background", ident)
        _fill(made[ident], bkgd[ident], f.background_parts, f, None, read)

    order: list[int] = []
    told = None
    listed = by.get("LIST", {}).get(f.int4(head, 52), b"")
    if len(listed) >= 48:
        n, size = f.int4(listed, 16 - f.back), f.int2(listed, 28 - f.back) & 0xFFFF
        for k in range(n if size >= 4 else 0):
            e = f.pages + 6 * k
            if e + 6 > len(listed):
                break
            page = pages.get(f.int4(listed, e), b"")
            starts = range(f.entries, len(page) - 3, size)
            order += [f.int4(page, at) for at in starts[: f.int2(listed, e + 4) & 0xFFFF]]
    if len(head) >= 48:
        told = f.int4(head, 44)
    order = [i for i in order if i in cards] or [i for k, i, _ in found if k == "CARD"]
    out = []
    for ident in order:
        b = cards[ident]
        c = Layer("card", ident)
        if len(b) >= 40:
            c.background = f.int4(b, 36 - f.back)
        _fill(c, b, 40 - f.back, f, made.get(c.background), read)
        out.append(c)
    externals = [(kind, name) for kind, _, name, _ in resources(rsrc) if kind in ("XCMD", "XFCN") and name]
    return Stack(version, read.script(head[f.script :]) if len(head) > f.script else Script(), list(made.values()), out, externals, told)


def _code(line: str) -> str:
    """A line without its comment; quotes in it toggle."""
    parts = line.split('"')
    for k in range(0, len(parts), 2):  # outside quotes
        cut = parts[k].find("--")
        if cut >= 0:
            return '"'.join([*parts[:k], parts[k][:cut]]).strip()
    return line.strip()


def indent(source: str) -> str:
    """A script as its editor shows it: two spaces per open handler, loop or if; else, then and end
    stand with what they belong to; a line continued by ¬ takes the level of its first."""
    out: list[str] = []
    levels: list[tuple[str, str]] = []  # kind, and a handler's name
    waiting = ""  # one-line: an if that its else may follow; then: an if, or else-then: an else if, without its then
    lines = iter([x.strip() for x in source.split("\n")])
    for line in lines:
        group = [line]
        while _code(group[-1]).endswith("¬"):
            more = next(lines, None)
            if more is None:
                break
            group.append(more)
        words = _code(" ".join(group)).lower().split()
        depth = len(levels)
        if words:
            was, waiting = waiting, ""
            first, last = words[0], words[-1]
            second = words[1] if len(words) > 1 else ""
            if first in ("on", "function"):
                spelt = group[0].lower().split()
                levels, depth = [("on", spelt[1] if len(spelt) > 1 else "")], 0
            elif first == "end":
                handler = next((k for k in reversed(range(len(levels))) if levels[k][0] == "on"), None)
                if second in ("if", "repeat"):
                    del levels[-1:]
                    depth = len(levels)
                elif handler is not None and levels[handler][1] == second:
                    del levels[handler:]
                    depth = len(levels)
            elif first == "repeat":
                levels.append(("repeat", ""))
            elif first == "then" and was == "else-then":
                depth -= 1
            elif first == "then" and was == "then":
                if last == "then":
                    levels.append(("if", ""))
                else:
                    waiting = "one-line"
            elif first == "if":
                if last == "then":
                    levels.append(("if", ""))
                else:
                    waiting = "one-line" if "then" in words else "then"
            elif first == "else":
                again = second == "if"
                if was != "one-line" and levels and levels[-1][0] == "if":
                    depth -= 1
                    if last not in ("else", "then") and not again:
                        levels.pop()
                    if second == "repeat":
                        levels.append(("repeat", ""))
                elif last in ("else", "then"):
                    levels.append(("if", ""))
                if again and last != "then":
                    waiting = "one-line" if "then" in words else "else-then" if depth < len(levels) else "then"
        out += ["  " * max(depth, 0) + x if x else "" for x in group]
    return "\n".join(out)


def scripts_listing(s: Stack, decompile=None) -> str:
    """All scripts in order, each under a comment that names its owner."""
    out: list[str] = []

    def add(owner: str, sc: Script) -> None:
        if sc.compiled and sc.language == "AppleScript" and decompile:
            shown = decompile(sc.compiled)
        elif sc.compiled:
            shown = f"-- ({len(sc.compiled)} bytes of compiled {sc.language})"
        else:
            shown = sc.text if sc.language else indent(sc.text)
        if shown.strip():
            out.append(f"-- {owner}{f' ({sc.language})' if sc.language else ''}\n" + shown.rstrip("\n") + "\n")

    add("stack", s.script)
    for layer in [*s.backgrounds, *s.cards]:
        add(layer.label, layer.script)
        for p in layer.parts:
            add(f"{layer.kind} {label(p.kind, p.name, p.ident)} of {layer.label}", p.script)
    head = "".join(f"-- external {what}: {', '.join(n)}\n" for what, kind in (("commands", "XCMD"), ("functions", "XFCN")) if (n := [x for k, x in s.externals if k == kind]))
    return head + "\n" * bool(head and out) + "\n".join(out)


def text_listing(s: Stack) -> str:
    """All fields' texts: those that backgrounds share, then each card's."""
    out = []
    for layer in [*s.backgrounds, *s.cards]:
        for p, t, shared in layer.texts:
            if t:
                named = label(p.kind, p.name, p.ident) if p else "field"
                where = "background" if shared else "card"
                out.append(f"-- {where} {named} of {layer.label}\n" + t.replace("\r", "\n").rstrip("\n") + "\n")
    return "\n".join(out)
