"""Card projects: blocks by id, windows with their cards and backgrounds, objects, menus, field texts, and listings."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from palimpsest.functions.encodings import ROMAN, decode_or_roman, detect
from palimpsest.functions.stacks import indent, label

PROJECT, CARD_LIST, WINDOW, MENU, CARD, BACKGROUND = 0, 2, 4, 5, 7, 8
DEEPEST = 8
PROTECTED = b"CE%" + bytes(5)
TOKENS = b"\x13\x45\x77\xff"
TOKENIZED = "-- (a script kept as tokens, without source text)"


@dataclass(frozen=True)
class Form:
    """Where each kind of block keeps its script, and how long an object's and a menu item's record is."""

    script: dict[int, int]
    obj: int
    item: int

    @staticmethod
    def shifted(by: int) -> Form:
        at = {PROJECT: 38, MENU: 42, BACKGROUND: 48, CARD: 52, WINDOW: 68}
        return Form({k: v + by for k, v in at.items()}, 82 + by, 26 + by)


FORMS = {0: Form.shifted(0), 1: Form.shifted(2), 2: Form.shifted(16)}


@dataclass
class Thing:
    ident: int
    kind: str
    name: str = ""
    script: str = ""
    text: str = ""


@dataclass
class Layer:
    kind: str
    ident: int = -1
    name: str = ""
    script: str = ""
    things: list[Thing] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)
    background: Layer | None = None
    shared: dict[int, str] = field(default_factory=dict)  # texts in the background's fields, by id

    def texts(self) -> list[tuple[Thing, str]]:
        """Texts in fields that the background still has, in its fields' order."""
        back = self.background.things if self.background else []
        return [(t, self.shared[t.ident]) for t in back if t.kind == "field" and t.ident in self.shared]


@dataclass
class Window:
    name: str = ""
    script: str = ""
    backgrounds: list[Layer] = field(default_factory=list)
    cards: list[Layer] = field(default_factory=list)


@dataclass
class Menu:
    name: str = ""
    script: str = ""
    items: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Project:
    major: int
    minor: int
    script: str = ""
    windows: list[Window] = field(default_factory=list)
    menus: list[Menu] = field(default_factory=list)
    unlisted: list[Layer] = field(default_factory=list)


class NotAProject(ValueError):
    pass


def _four(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "big")


def _two(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 2], "big")


def project_bytes(b: bytes) -> bytes | None:
    """The project in a file: all of it, or what a standalone application holds around its code."""
    if len(b) < 0x600:
        return None
    major, minor, size, n = _two(b, 0), _two(b, 2), _four(b, 4), _four(b, 16)
    if major not in (1, 2) or minor > 15 or not n or n % 128 or 0x400 + 4 * n > size:
        return None
    if size < len(b) and b[0x400:0x408] == b"Joy!peff":
        b = b[:0x400] + b[len(b) - (size - 0x400) :]
    elif size != len(b):
        return None
    first = _four(b, 0x400)
    fits = 0x400 + 4 * n <= first <= size - 16 and _four(b, first) == 0 and _two(b, first + 12) == PROJECT
    return b if fits else None


def record(b: bytes, at: int) -> tuple[bytes, int] | None:
    """A record's bytes, and where the next is: lengths are padded to even."""
    if at < 0 or at + 4 > len(b) or (n := _four(b, at)) > len(b) - at - 4:
        return None
    return b[at + 4 : at + 4 + n], at + 4 + n + n % 2


def _rows(b: bytes, at: int, end: int) -> tuple[list[bytes], bool]:
    """The records from at, and whether they end just at end."""
    out = []
    while at < end and (r := record(b, at)):
        out.append(r[0])
        at = r[1]
    return out, at == end


def _has_state(n: int) -> bool:
    """Whether n bytes are what a script's editor leaves after the text, its zero counted."""
    return n in (23, 24, 27)


def is_script(r: bytes) -> bool:
    if r.startswith((TOKENS, PROTECTED)):
        return True
    zero = r.find(0)
    if zero < 0 or not _has_state(len(r) - zero):
        return False
    top, left, bottom, right = struct.unpack(">4h", r[-8:])
    return top < bottom and left < right


def is_name(r: bytes) -> bool:
    return len(r) < 256 and 0 not in r


def unprotected(r: bytes) -> bytes:
    """A protected script's record: every bit of 0xFD is turned, in all of it or up to the last return."""
    turned = bytes(c ^ 0xFD for c in r)
    zero = turned.find(0)
    if zero >= 0 and _has_state(len(r) - zero):
        return turned
    zero = r.find(0)
    return turned[: zero - 1] + r[zero - 1 :] if zero > 0 else turned


@dataclass
class Slots:
    """Which records an object has: data, name, script, and at most so many more."""

    data: bool
    name: bool
    script: bool
    more: int


def match(slots: list[Slots], rows: list[bytes]) -> list[int] | None:
    """How many further records each object has, so that names and scripts fall on records that can
    be such; the most for the first object that it can have, then for the next. None if nothing fits."""
    dead: set[tuple[int, int]] = set()
    chosen: list[tuple[int, Iterator[int], int]] = []  # the record where an object starts, choices left, the choice

    def choices(i: int, j: int) -> Iterator[int]:
        s, k = slots[i], j + slots[i].data
        for wanted, fits in ((s.name, is_name), (s.script, is_script)):
            if wanted:
                if k >= len(rows) or not fits(rows[k]):
                    return
                k += 1
        for m in range(s.more, -1, -1):
            if k + m <= len(rows) and not any(map(is_script, rows[k : k + m])):
                yield m

    def width(i: int, m: int) -> int:
        s = slots[i]
        return s.data + s.name + s.script + m

    j = 0
    while True:
        i = len(chosen)
        if i == len(slots):
            if j == len(rows):
                return [m for _, _, m in chosen]
            options: Iterator[int] = iter(())
        elif (i, j) in dead:
            options = iter(())
        else:
            dead.add((i, j))
            options = choices(i, j)
        m = next(options, None)
        while m is None:
            if not chosen:
                return None
            j, options, _ = chosen.pop()
            m = next(options, None)
        chosen.append((j, options, m))
        j += width(len(chosen) - 1, m)


def _same_heap(handle: int, r: bytes, places: tuple[int, ...]) -> bool:
    return bool(handle) and not handle & 1 and any((o := _four(r, at)) and o >> 16 == handle >> 16 for at in places)


class Reader:
    """Reads the blocks in one encoding, keeping the bytes of names and scripts."""

    def __init__(self, b: bytes, encoding: str):
        self.major, self.minor = _two(b, 0), _two(b, 2)
        self.form = FORMS[2 if self.major == 2 else min(self.minor, 1)]
        self.encoding = encoding
        self.kept: list[bytes] = []
        self.blocks: dict[int, tuple[int, bytes]] = {}
        n = _four(b, 16)
        for ident in range(n):
            at = _four(b, 0x400 + 4 * ident)
            if at % 64 or not 0x400 + 4 * n <= at <= len(b) - 16 or _four(b, at) != ident:
                continue
            end = at + 12 + _four(b, at + 4)
            if at + 16 <= end <= len(b):
                self.blocks[ident] = (_two(b, at + 12), b[at:end])

    def text(self, b: bytes) -> str:
        self.kept.append(b)
        return decode_or_roman(b, self.encoding)

    def source(self, r: bytes) -> str:
        if r.startswith(TOKENS):
            return TOKENIZED
        if r.startswith(PROTECTED):
            r = unprotected(r[len(PROTECTED) :])
        r = r.partition(b"\0")[0]
        if self.encoding == ROMAN:
            return self.text(r).replace("\r", "\n")
        # the sign that continues a line is the byte of ¬ in every encoding
        return "\n".join(self.text(x[:-1]) + "¬" if x.endswith(b"\xc2") else self.text(x) for x in r.split(b"\r"))

    def script(self, b: bytes, at: int) -> tuple[str, int]:
        r = record(b, at)
        return (self.source(r[0]), r[1]) if r else ("", len(b))

    def last_name(self, b: bytes, at: int) -> str:
        rows, _ = _rows(b, at, len(b))
        return self.text(rows[-1] if rows else b"")

    def field_text(self, d: bytes) -> str | None:
        """Past the style runs and before the default style; its fonts' own signs stay out of the guess at the encoding."""
        start, end = 2 + 20 * _two(d, 0), len(d) - 14
        if len(d) < 16 or start > end:
            return None
        return decode_or_roman(d[start:end].rstrip(b"\0"), self.encoding).replace("\r", "\n")

    def _split(self, b: bytes, size: int) -> tuple[list[bytes], list[bytes]] | None:
        """An object list's fixed records, and those that their handles point to."""
        if len(b) < 2 or _two(b, len(b) - 2) * size > len(b) - 2:
            return None
        n = _two(b, len(b) - 2)
        rows, ends = _rows(b, n * size, len(b) - 2)
        return ([b[k * size : (k + 1) * size] for k in range(n)], rows) if ends else None

    def things(self, layer: Layer, b: bytes, depth: int = 0) -> None:
        found = self._split(b, self.form.obj)
        if found is None or any(not 100 <= _two(r, 0) < 400 for r in found[0]):
            return
        fixed, rows = found
        slots = []
        for r in fixed:
            name, data, script = (_four(r, at) != 0 for at in (58, 62, 66))
            more = (_four(r, 86) != 0) + sum(_same_heap(_four(r, at), r, (58, 62, 66, 86)) for at in (72, 78, 94)) if self.form.obj == 98 else 0
            slots.append(Slots(data, name, script, more))
        made = [Thing(_four(r, 6), {1: "graphic", 2: "button"}.get(_two(r, 0) // 100, "field")) for r in fixed]
        extras = match(slots, rows)
        if extras is None:
            layer.things += made
            layer.unmatched += [s for r in rows if is_script(r) and (s := self.source(r)).strip()]
            return
        left = iter(rows)
        for r, s, t, extra in zip(fixed, slots, made, extras):
            data = next(left) if s.data else None
            if data is not None and t.kind == "field":
                t.text = self.field_text(data) or ""
            if s.name:
                t.name = self.text(next(left))
            if s.script:
                t.script = self.source(next(left))
            for _ in range(extra):
                next(left)
            layer.things.append(t)
            if data is not None and _two(r, 0) == 108 and depth < DEEPEST:
                self.things(layer, data, depth + 1)

    def layer(self, b: bytes, kind: str) -> Layer:
        made = Layer(kind)
        made.script, at = self.script(b, self.form.script[CARD if kind == "card" else BACKGROUND])
        end = at + 4 + _four(b, at)
        if at + 4 > len(b) or not at + 6 <= end <= len(b):
            return made
        self.things(made, b[at + 4 : end])
        first = record(b, end)
        if kind == "card" and first and first[1] < len(b):
            made.shared = self._shared(first[0])
        made.name = self.last_name(b, end)
        return made

    def _shared(self, r: bytes) -> dict[int, str]:
        out, at = {}, 0
        while at < len(r):
            n = _four(r, at + 4)
            if at + 8 > len(r) or n > len(r) - at - 8:
                return {}
            t = self.field_text(r[at + 8 : at + 8 + n])
            if t is not None:
                out[_four(r, at)] = t
            at += 8 + n
        return out

    def window(self, b: bytes, seen: set[int]) -> Window:
        w = Window()
        at = self.form.script[WINDOW] - 8
        n = _two(b, at)
        after = at + 2 + 6 * n
        if len(b) < after + 4:
            return w
        lists = [_four(b, at + 4 + 6 * k) for k in range(n)]
        w.script, at = self.script(b, after)
        w.name = self.last_name(b, at)
        made: dict[int, Layer] = {}
        for held in lists:
            kind, rows = self.blocks.get(held, (None, b""))
            for e in range(14, len(rows) - 63, 64) if kind == CARD_LIST else ():
                card, back, card_id, back_id = struct.unpack_from(">4I", rows, e)
                if self.blocks.get(card, (None,))[0] != CARD:
                    continue
                seen.add(card)
                c = self.layer(self.blocks[card][1], "card")
                c.ident = card_id
                if back not in made and self.blocks.get(back, (None,))[0] == BACKGROUND:
                    seen.add(back)
                    made[back] = self.layer(self.blocks[back][1], "background")
                    made[back].ident = back_id
                    w.backgrounds.append(made[back])
                c.background = made.get(back)
                w.cards.append(c)
        return w

    def menu(self, b: bytes) -> Menu:
        m = Menu()
        m.script, at = self.script(b, self.form.script[MENU])
        end = at + 4 + _four(b, at)
        if at + 4 > len(b) or not at + 6 <= end <= len(b):
            return m
        found = self._split(b[at + 4 : end], self.form.item)
        if found:
            fixed, rows = found
            slots = [Slots(False, _four(r, 18) != 0, _four(r, 22) != 0, sum(_same_heap(_four(r, p), r, (18, 22)) for p in range(26, len(r) - 3, 4))) for r in fixed]
            extras = match(slots, rows)
            left = iter(rows)
            for s, extra in zip(slots, extras or ()):
                m.items.append((self.text(next(left)) if s.name else "", self.source(next(left)) if s.script else ""))
                for _ in range(extra):
                    next(left)
        m.name = self.last_name(b, end)
        return m

    def project(self) -> Project:
        p, seen = Project(self.major, self.minor), set()
        for ident, (kind, b) in self.blocks.items():
            if kind == PROJECT and ident == 0:
                p.script = self.script(b, self.form.script[PROJECT])[0]
            elif kind == WINDOW:
                p.windows.append(self.window(b, seen))
            elif kind == MENU:
                p.menus.append(self.menu(b))
        for ident, (kind, b) in self.blocks.items():
            if ident not in seen and kind in (CARD, BACKGROUND):
                p.unlisted.append(self.layer(b, "card" if kind == CARD else "background"))
        return p


def parse(data: bytes, encoding: str | None = None) -> Project:
    """A project; without an encoding, in the one that its names and scripts show."""
    b = project_bytes(data)
    if b is None:
        raise NotAProject("no project")
    if encoding is None:
        first = Reader(b, ROMAN)
        found = first.project()
        encoding = detect(first.kept)
        if encoding == ROMAN:
            return found
    return Reader(b, encoding).project()


def layers(p: Project) -> Iterator[tuple[str, Window | None, Layer | None]]:
    """Each window, background and card with the name by which scripts call it."""
    for k, w in enumerate(p.windows):
        name = f'window "{w.name}"' if w.name else f"window {k + 1}"
        yield name, w, None
        for x in [*w.backgrounds, *w.cards]:
            yield f"{label(x.kind, x.name, x.ident)} of {name}", w, x
    for k, x in enumerate(p.unlisted):
        yield f'{x.kind} "{x.name}"' if x.name else f"{x.kind} {k + 1} that no window lists", None, x


def labels(x: Layer) -> list[str]:
    """The names of a layer's objects; those that share one are told apart by their ids."""
    used = Counter((t.kind, t.name) for t in x.things)
    return [label(t.kind, t.name, t.ident) + (f" (id {t.ident})" if t.name and used[t.kind, t.name] > 1 else "") for t in x.things]


def scripts_listing(p: Project) -> str:
    out: list[str] = []

    def add(owner: str, source: str) -> None:
        if source.strip():
            out.append(f"-- {owner}\n" + (source if source == TOKENIZED else indent(source)).rstrip("\n") + "\n")

    add("project", p.script)
    for name, w, x in layers(p):
        add(name, x.script if x else w.script)
        for t, own in zip(x.things, labels(x)) if x else ():
            add(f"{x.kind} {own} of {name}", t.script)
        for s in x.unmatched if x else ():
            add(f"script of an object of {name} (it is not known which)", s)
    for k, m in enumerate(p.menus):
        name = f'menu "{m.name}"' if m.name else f"menu {k + 1}"
        add(name, m.script)
        for j, (item, source) in enumerate(m.items):
            add((f'menuItem "{item}"' if item else f"menuItem {j + 1}") + f" of {name}", source)
    return "\n".join(out)


def text_listing(p: Project) -> str:
    """Fields' texts, card by card; a background's own only where no card shows the same."""
    out = []
    for name, w, x in layers(p):
        if x is None:
            continue
        rows = []
        if x.kind == "card" and x.background:
            own = dict(zip(map(id, x.background.things), labels(x.background)))
            rows += [(f"background {own[id(t)]} of {name}", text) for t, text in x.texts()]
        for t, own in zip(x.things, labels(x)):
            shown = x.kind == "background" and any(c.background is x and any(a is t and b == t.text for a, b in c.texts()) for c in (w.cards if w else ()))
            if not shown:
                rows.append((f"{x.kind} {own} of {name}", t.text))
        out += [f"-- {owner}\n" + text.rstrip("\n") + "\n" for owner, text in rows if text]
    return "\n".join(out)
