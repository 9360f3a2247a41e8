"""Source text of compiled scripts from their syntax trees.

A script's records become one index by reference; Printer turns nodes into lines (statements) and
strings (expressions), one small method per node letter, found by table. Terms come from the
language's own table and, where given, from dictionaries of the application in scope; others are
printed by their codes. Trees that turn back on themselves or nest too deep print a mark instead.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from palimpsest.functions.forks import fasd_header, is_plain, jxa, roman
from palimpsest.functions.records import EVENT_KIND, Damaged, Graph, Record, body, names, old_text, quoted, reading, real, records, tolerant
from palimpsest.functions.terms import CODES, EVENTS, PARAMETERS, PREPOSITIONS, RESERVED, SYMBOL_CONSTANTS, SYMBOL_EVENTS, SYMBOLS

DEEPEST = 300
BREAK = "￿"
SHARED_CLASSES = frozenset("TEXT utxt list reco long doub nmbr bool alis enum scpt hand".split()) | {"ldt "}
TEXT, SPECIFIER, APP_TERM, OPTIONAL = 0xB1, 0x15, 0x7A, 0x7C
ALT, POSSESSIVE, PARENS, CONTINUED, THE, IMPLICIT = 1, 2, 4, 8, 0x100, 0x8000

#: Applications that came with the system: the editor shows them by name, others by their file's.
SHIPPED = frozenset(
    "Address Book|AppleScript Editor|Automator|Calendar|Console|Contacts|Database Events|Dictionary|Disk Utility|Finder|Font Book|Image Events|Keychain Access|Mail|Messages|Music|Notes|"
    "Photos|Preview|QuickTime Player|Reminders|Safari|Script Editor|System Events|System Preferences|System Settings|Terminal|TextEdit|iCal|iChat|iTunes".split("|")
)
#: letter -> sign and how tightly it binds
INFIX = {
    "a": ("^", 9), "]": ("*", 8), "^": ("/", 8), "_": ("div", 8), "`": ("mod", 8), "[": ("+", 7), "\\": ("-", 7), "b": ("&", 6), "A": ("<", 4), "B": ("≤", 4),
    "?": (">", 4), "@": ("≥", 4), "C": ("starts with", 4), "D": ("ends with", 4), "E": ("contains", 4), "=": ("=", 3), ">": ("≠", 3), "F": ("and", 1), "G": ("or", 0),
}
#: letter and flags -> the words that the source had for the sign
SPELT = {
    ("=", 3): "is", ("=", 1): "is equal to", (">", 0x100): "is not", (">", 1): "is not equal to", ("A", 1): "is less than", ("?", 1): "is greater than",
    ("A", 0x101): "comes before", ("?", 0x101): "comes after", ("A", 0x100): "is not greater than or equal to", ("?", 0x100): "is not less than or equal to",
    ("B", 1): "is less than or equal to", ("@", 1): "is greater than or equal to", ("B", 0x100): "is not greater than", ("@", 0x100): "is not less than",
    ("B", 0x101): "does not come after", ("@", 0x101): "does not come before", ("C", 0x100): "begins with",
}
ATOM, AS, NOT = 10, 5, 2
COUNTED = dict(enumerate("first second third fourth fifth sixth seventh eighth ninth tenth".split(), 1)) | {-1: "last"}


@dataclass
class Dictionary:
    """One application's terms by code: names of classes, properties, constants, events, and labels by event/label."""

    classes: dict[str, str] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    constants: dict[str, str] = field(default_factory=dict)
    events: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    plurals: dict[str, str] = field(default_factory=dict)

    def find(self, code: str, kind: str) -> str:
        order = {"class": (self.classes, self.properties, self.constants), "property": (self.properties, self.classes)}
        return next((m[code] for m in order.get(kind, (self.properties, self.classes, self.constants)) if code in m), "")

    def words(self) -> set[str]:
        return {n.lower() for m in (self.classes, self.properties, self.constants, self.events, self.plurals) for n in m.values()}


def four(b: bytes) -> str:
    return roman(b) if all(c >= 0x20 and c != 0x7F for c in b) else f"0x{int.from_bytes(b, 'big'):08x}"


def raw_code(code: str) -> str:
    return roman(bytes.fromhex(code[2:])) if re.fullmatch("0x[0-9a-f]{8}", code) else code


def rounded(x: float) -> str:
    """A real as the editor shows it: to 12 places."""
    if x == 0 or 1e-3 < abs(x) < 1e4:
        text = f"{x:.12f}".rstrip("0")
        return text + "0" if text.endswith(".") else text
    return real(x)


def plural(name: str) -> str:
    if name.lower().endswith("text") or name.startswith("«"):
        return name
    if re.search("(s|x|ch|sh)$", name):
        return name + "es"
    return name[:-1] + "ies" if re.search("[^aeiou]y$", name) else name + "s"


def listed(words: list[str]) -> str:
    """a, b and c"""
    return "".join(words) if len(words) < 2 else ", ".join(words[:-1]) + " and " + words[-1]


def ordinal(n: int) -> str:
    return f"{n}{'th' if 10 < n % 100 < 14 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def bars(name: str) -> str:
    return "|" + name.replace("\\", "\\\\").replace("|", "\\|").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r") + "|"


def barred(name: str) -> str:
    """A name, in bars unless it is a plain word that the language doesn't keep for itself."""
    return name if re.fullmatch("[A-Za-z_][A-Za-z0-9_]{0,199}", name) and name.lower() not in RESERVED else bars(name)


def alias_tag(a: bytes, wanted: int) -> bytes:
    at = 150
    while at + 4 <= len(a):
        tag, n = struct.unpack_from(">hH", a, at)
        if tag == -1 or at + 4 + n > len(a):
            break
        if tag == wanted:
            return a[at + 4 : at + 4 + n]
        at += 4 + n + n % 2
    return b""


def described(kind: str, data: bytes) -> str:
    """A descriptor as a literal: a date, an alias, or its bytes."""
    if kind == "ldt " and len(data) == 8:
        seconds = int.from_bytes(data, "big", signed=True)
        try:
            t = datetime(1904, 1, 1) + timedelta(seconds=seconds)
            return f'date "{t:%A}, {t:%B} {t.day}, {t.year} at {(t.hour + 11) % 12 + 1}:{t:%M:%S}\u202f{"AM" if t.hour < 12 else "PM"}"'
        except OverflowError:
            pass
    if kind == "alis" and len(data) >= 150:
        path = roman(alias_tag(data, 2))
        if posix := alias_tag(data, 18):
            path = "Macintosh HD:" + posix.decode("utf-8", "replace").removeprefix("/").replace("/", ":")
        if path:
            return "alias " + quoted(path + ":" * (data[8:10] == b"\0\1" and not path.endswith(":")))
    return f"«data {kind}{data.hex().upper()}»"


@dataclass
class Node:
    letter: str
    flags: int
    kids: tuple[int, ...]

    def kid(self, k: int) -> int:
        """The k-th child if it is a node or shared object, else 0."""
        return self.kids[k] if k < len(self.kids) and self.kids[k] > 0 else 0

    @property
    def head(self) -> int:
        return self.kids[0] if self.kids else 0

    @property
    def first(self) -> int:
        return next((k for k in self.kids if k > 0), 0)


class Index:
    """A script's records by what they are. Of equal references the first name or code counts, else the last record."""

    def __init__(self, rows: list[Record]):
        self.nodes: dict[int, Node] = {}
        self.cells: dict[int, tuple[int, ...]] = {}
        self.wraps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.names: dict[int, str] = {}
        self.spelling: dict[str, str] = {}
        self.in_bars: set[int] = set()
        self.codes: dict[int, str] = {}
        self.enums: dict[int, str] = {}
        self.events: dict[int, str] = {}
        self.ints: dict[int, int] = {}
        self.reals: dict[int, float] = {}
        self.texts: dict[int, str] = {}
        self.old_texts: dict[int, str] = {}
        self.apps: dict[int, str] = {}
        self.data: dict[int, tuple[str, bytes]] = {}
        self.empty: set[int] = set()
        for r in rows:
            take = getattr(self, f"_{r.typ:02x}", None)
            if take:
                take(r)

    def _01(self, r: Record) -> None:
        number, tag = divmod(int.from_bytes(r.data, "big"), 8)
        if len(r.data) != 4 or tag != 1:
            return
        if number in SYMBOLS:
            self.codes.setdefault(r.ref, SYMBOLS[number])
        elif number in SYMBOL_EVENTS:
            self.events.setdefault(r.ref, SYMBOL_EVENTS[number])
        elif number in SYMBOL_CONSTANTS:
            self.enums.setdefault(r.ref, SYMBOL_CONSTANTS[number][0])
            self.codes.setdefault(r.ref, SYMBOL_CONSTANTS[number][1])

    def _02(self, r: Record) -> None:
        if r.refs:
            self.cells[r.ref] = r.refs
        elif r.typ == 2:
            self.empty.add(r.ref)

    _06 = _10 = _02

    def _03(self, r: Record) -> None:
        self.ints[r.ref] = r.size - (r.size & 0x8000) * 2

    def _07(self, r: Record) -> None:
        if len(r.data) == 4:
            self.ints[r.ref] = int.from_bytes(r.data, "big", signed=True)

    def _08(self, r: Record) -> None:
        if len(r.data) == 8:
            self.reals[r.ref] = struct.unpack(">d", r.data)[0]

    def _0a(self, r: Record) -> None:
        if r.kind == EVENT_KIND and len(r.data) >= 8:
            self.events.setdefault(r.ref, roman(r.data[:8]))
        elif len(r.data) == 4:
            self.codes.setdefault(r.ref, four(r.data))
        elif len(r.data) == 8:
            self.enums.setdefault(r.ref, four(r.data[:4]))
            self.codes.setdefault(r.ref, four(r.data[4:]))

    def _0b(self, r: Record) -> None:
        at, spelt = 0, []
        while at + 2 <= len(r.data):  # a name in bars is followed by an empty one
            (n,) = struct.unpack_from(">H", r.data, at)
            if at + 2 + n > len(r.data):
                break
            spelt += names(r.data[at : at + 2 + n]) or [""]
            at += 2 + n
        best = next((s for s in spelt if s != s.lower()), spelt[0] if spelt else "")
        if best:
            self.spelling.setdefault(best.lower(), best)
        if r.ref < 0:
            if len(spelt) == 2 and spelt[1] == "" and spelt[0] != spelt[0].lower():
                self.in_bars.add(r.ref)
            if best:
                self.names.setdefault(r.ref, best)

    def _0c(self, r: Record) -> None:
        n = int.from_bytes(r.data[:2], "big")
        if len(r.data) >= 2 + n:
            self.old_texts[r.ref] = old_text(r.data[2 : 2 + n])

    def _0d(self, r: Record) -> None:
        self.nodes[r.ref] = Node(chr(r.kind or 0), r.flags or 0, r.refs)

    def _04(self, r: Record) -> None:
        self.wraps[r.ref] = (r.kind or 0, r.refs)

    _0e = _04

    def _11(self, r: Record) -> None:
        self.texts[r.ref] = r.data[: len(r.data) & ~1].decode("utf-16-be", "replace")

    _13 = _11

    def _0f(self, r: Record) -> None:
        if r.kind == 0x0D and len(r.data) >= 4:
            self.data[r.ref] = (roman(r.data[:4]), r.data[4:])
            return
        _, found, url = r.data.partition(b"aprl")
        run = re.search(rb"[\x20-\x7e]+", url)
        if found and run:
            text = run[0].decode()
            self.apps[r.ref] = text.rsplit("/", 1)[-1].removesuffix(".app") if text.startswith("file://localhost") else text
            return
        for m in re.finditer(b"alis", r.data):
            a = r.data[m.end() :]
            if len(a) > 51 and 0 < a[50] < 64 and len(a) >= 51 + a[50]:
                name = roman(a[51 : 51 + a[50]])
                if wide := alias_tag(a, 14):
                    name = wide[2:].decode("utf-16-be", "replace") or name
                self.apps[r.ref] = name
                return

    _12 = _0f

    def chain(self, ref: int, width: int = 2) -> Iterator[tuple[int, ...]]:
        """The cells of a list, or of labelled values, until it ends or turns back."""
        seen: set[int] = set()
        while ref > 0 and ref not in seen and len(self.cells.get(ref, ())) == width:
            seen.add(ref)
            yield self.cells[ref]
            ref = self.cells[ref][-1]

    def text(self, ref: int) -> str | None:
        kind_refs = self.wraps.get(ref)
        return self.texts.get(kind_refs[1][0]) if kind_refs and kind_refs[1] else self.texts.get(ref + 1)


class Printer:
    def __init__(self, x: Index, dictionaries: dict[str, Dictionary] | None = None, rebuilt: bool = False):
        self.x, self.nodes, self.rebuilt = x, x.nodes, rebuilt
        self.known = dictionaries or {}
        self.common = Dictionary(CODES, CODES, CODES, EVENTS)
        self.scopes = [a for n in x.nodes.values() if n.letter == "x" and (a := self.app(n.kid(1)))]
        uses = [n for n in x.nodes.values() if n.letter == "x"]
        self.no_additions = bool(uses) and not any((t := x.nodes.get(n.kid(1))) and t.letter == "2" and x.codes.get(t.head) == "osax" for n in uses)
        self.depth = 0
        self.busy: set[tuple[str, int]] = set()
        self.labels: set[str] = set()
        self.aimed: set[int] = set()
        self.moved: set[int] = set()
        self.breaks = self.loops = 0
        self.in_my = False

    # --- names -------------------------------------------------------------------------------

    def dictionaries(self) -> list[Dictionary]:
        """Of the innermost application only, then those that every script has."""
        own = self.known.get(re.sub(r"\.app$", "", self.scopes[-1].rstrip("/:").replace(":", "/").rsplit("/", 1)[-1])) if self.scopes else None
        return [d for d in (own, self.known.get(""), self.known.get("AppleScript"), self.common) if d]

    def term(self, code: str, kind: str) -> str:
        if code in SHARED_CLASSES:
            return CODES[code]
        for d in self.dictionaries():
            if found := d.find(code, kind):
                return found
        return f"«class {raw_code(code)}»"

    def event(self, code: str) -> str:
        return next((d.events[code] for d in self.dictionaries() if code in d.events), f"«event {code}»")

    def is_term(self, name: str) -> bool:
        low = name.lower()
        return low in self.labels or any(low in d.words() for d in self.dictionaries() if d is not self.common and not (self.no_additions and d is self.known.get("")))

    def named(self, ref: int, kind: str = "value") -> str:
        x = self.x
        wrap = x.wraps.get(ref)
        if wrap and wrap[0] == APP_TERM and len(wrap[1]) == 2:
            with_app = self.app(wrap[1][1])
            self.scopes += [with_app] * bool(with_app)
            try:
                return self.named(wrap[1][0], kind)
            finally:
                del self.scopes[len(self.scopes) - bool(with_app) :]
        if name := x.names.get(ref):
            return bars(name) if ref in x.in_bars or self.is_term(name) else barred(name)
        if ref in x.events:
            return self.event(x.events[ref])
        if ref in x.codes:
            enum = x.enums.get(ref)
            if enum and enum not in ("enum", "boov", "type", "****") and self.term(x.codes[ref], kind).startswith("«"):
                return f"«constant {raw_code(enum)}{raw_code(x.codes[ref])}»"
            return self.term(x.codes[ref], kind)
        return f"<ref{ref}>"

    def has_name(self, ref: int) -> bool:
        return ref in self.x.names or ref in self.x.events or ref in self.x.codes or self.x.wraps.get(ref, (0,))[0] == APP_TERM

    def built_in(self, ref: int) -> bool:
        return ref in self.x.events and ref not in self.x.names

    def plural(self, ref: int) -> str:
        code = self.x.codes.get(ref)
        for d in self.dictionaries():
            if code in d.plurals:
                return d.plurals[code]
        name = self.named(ref, "class")
        return "every " + name if name.startswith("«") else plural(name)

    def label(self, event: str, ref: int) -> str:
        code = self.x.codes.get(ref)
        if code is None:
            return self.named(ref)
        for d in self.dictionaries():
            if f"{event}/{code}" in d.labels:
                return d.labels[f"{event}/{code}"]
        known = code in PARAMETERS and not self.event(event).startswith("«")
        return PARAMETERS[code] if known else f"«class {raw_code(code)}»"

    def app(self, ref: int, steps: int = 0) -> str:
        """The application that an expression specifies, or nothing."""
        x = self.x
        if ref in x.apps:
            return x.apps[ref].removesuffix(".app")
        n = x.nodes.get(ref)
        if n is None or steps > DEEPEST:
            return ""
        if n.letter in "ml":
            return self.app(n.first, steps + 1)
        if n.letter == "n":
            return self.app(n.kid(1), steps + 1)
        if n.letter == "4" and len(n.kids) == 2 and x.codes.get(n.head) == "capp":
            lit = x.nodes.get(self.bare(n.kids[1]))
            if lit and lit.letter == "m":
                return (x.text(lit.kid(0)) or "").removesuffix(".app")
        return ""

    # --- what a node is ------------------------------------------------------------------------

    def letter(self, ref: int) -> str:
        n = self.nodes.get(ref)
        return n.letter if n else ""

    def bare(self, ref: int) -> int:
        """Past parentheses, articles and breaks."""
        for _ in range(16):
            n = self.nodes.get(ref)
            if n is None or n.letter != "l":
                break
            ref = n.first
        return ref

    def past_break(self, ref: int) -> int:
        n = self.nodes.get(ref)
        return n.first if n and n.letter == "l" and n.flags & CONTINUED and not n.flags & (PARENS | THE) else ref

    def truth(self, ref: int) -> str:
        n = self.nodes.get(ref)
        return {"true": "true", "fals": "false"}.get(self.x.codes.get(n.head, ""), "") if n and n.letter == "m" and n.kids else ""

    def command(self, ref: int) -> bool:
        n = self.nodes.get(ref)
        return n is not None and (n.letter == "e" or n.letter == "I" and bool(n.kids) and self.built_in(n.head))

    def takes_rest(self, ref: int) -> bool:
        n = self.nodes.get(ref)
        return n is not None and (n.letter == "e" or n.kid(1) > 0 or n.kid(2) > 0)

    def labelled(self, ref: int) -> bool:
        n = self.nodes.get(ref)
        return n is not None and n.letter == "I" and len(n.kids) > 2 and not self.built_in(n.head) and n.kid(2) != 0

    def of_me(self, ref: int) -> bool:
        n = self.nodes.get(ref)
        return n is not None and n.letter == "n" and bool(n.flags & ALT) and self.letter(self.past_break(n.kid(1))) == "f"

    def part_of(self, ref: int) -> bool:
        """Plainly x of y."""
        n = self.nodes.get(ref)
        return n is not None and n.letter == "n" and not n.flags & THE and not self.of_me(ref) and self.letter(n.head) not in ("8", "9")

    def bare_of(self, ref: int) -> bool:
        n = self.nodes.get(ref)
        if n is not None and n.letter == "c":
            ref = n.head
            n = self.nodes.get(ref)
        return n is not None and n.letter == "n" and not n.flags & POSSESSIVE and not self.of_me(ref)

    def spread(self, n: Node) -> str | None:
        """A name such as a_b_ with its arguments between: a:1 b:2."""
        name = self.x.names.get(n.head, "")
        if not name.endswith("_") or n.kid(2):
            return None
        parts, args = name[:-1].split("_"), [c[0] for c in self.x.chain(n.kid(1))]
        if len(parts) != len(args):
            return None
        return " ".join(f"{self.segment(p)}:{self._between(a)}" for p, a in zip(parts, args))

    def _between(self, ref: int) -> str:
        s, n = self.expr(ref), self.nodes.get(ref)
        if n is None:
            return s
        code = self.x.codes.get(n.head)
        constant = n.letter == "m" and code is not None and not self.truth(ref) and code not in ("yes ", "no  ") and not s.startswith("«")
        phrase = n.letter == "1" and " " in s and not s.startswith("«")
        loose = n.letter in "n45267cH" or n.letter in INFIX and INFIX[n.letter][1] <= 7
        return f"({s})" if constant or phrase or loose or n.letter == "I" and self.command(ref) else s

    def segment(self, part: str) -> str:
        part = self.x.spelling.get(part.lower(), part)
        return bars(part) if part and self.is_term(part) else barred(part)

    def spread_call(self, ref: int) -> bool:
        n = self.nodes.get(self.bare(ref))
        return n is not None and n.letter == "I" and not self.built_in(n.head) and self.spread(n) is not None

    def ends_spread(self, ref: int, steps: int = 0) -> bool:
        n = self.nodes.get(ref)
        if n is None or steps > DEEPEST:
            return False
        if n.letter == "n" and n.flags & (POSSESSIVE | ALT):
            return self.ends_spread(n.head, steps + 1)
        return n.letter == "I" and ref in self.aimed and self.spread_call(ref)

    def aim(self, ref: int) -> None:
        """Marks a call as having a target."""
        ref = self.bare(ref)
        if self.letter(ref) == "I":
            self.aimed.add(ref)

    def binds(self, ref: int, steps: int = 0) -> int:
        n = self.nodes.get(ref)
        if n is None or steps > DEEPEST:
            return ATOM
        if n.letter in INFIX:
            return INFIX[n.letter][1]
        if n.letter == "I" and ref in self.aimed and self.spread(n) is not None:
            return -1
        if n.letter == "n":
            return -1 if self.of_me(ref) else self.binds(n.head, steps + 1) if n.flags & POSSESSIVE else ATOM
        return {"H": NOT, "c": AS, "6": 0}.get(n.letter, ATOM)

    # --- expressions ---------------------------------------------------------------------------

    def expr(self, ref: int) -> str:
        key = ("e", ref)
        if self.depth > DEEPEST or key in self.busy:
            return "«…»"
        n = self.nodes.get(ref)
        if n is None:
            return self.literal(ref)
        self.busy.add(key)
        self.depth += 1
        try:
            if n.letter in INFIX:
                return self.infix(n)
            how = EXPRESSIONS.get(n.letter)
            return how(self, n, ref) if how else f"<{n.letter}{ref}>"
        finally:
            self.depth -= 1
            self.busy.discard(key)

    def inner(self, ref: int) -> str:
        """In parentheses if a command."""
        return f"({self.expr(ref)})" if self.command(ref) else self.expr(ref)

    def sub(self, ref: int, least: int) -> str:
        s = self.expr(ref)
        return f"({s})" if self.command(ref) or self.binds(ref) < least or least >= ATOM and self.labelled(ref) else s

    def mine_or(self, ref: int, least: int) -> str:
        return self.expr(ref) if self.of_me(ref) else self.sub(ref, least)

    def infix(self, n: Node) -> str:
        sign, force = INFIX[n.letter]
        if len(n.kids) < 2:
            return f"<{sign}>"
        a, b = n.kids[:2]
        if n.letter == "E" and n.flags & ALT:
            return f"{self.mine_or(b, force)} is in {self.mine_or(a, force + 1)}"
        if n.letter in "=>" and n.flags == POSSESSIVE and (p := self.nodes.get(a)) and p.letter == "n" and len(p.kids) == 2:
            return f"{self.expr(p.kids[1])} {'is' if n.letter == '=' else 'is not'} {self.expr(p.kids[0])}"
        sign = SPELT.get((n.letter, n.flags), sign)
        right_first = n.letter == "a"
        left, right = self.sub(a, force + right_first), self.sub(b, force + (not right_first))
        if self.rebuilt:
            left, right = (f"({s})" if self.labelled(k) else s for k, s in ((a, left), (b, right)))
        if force in (3, 4) and self.letter(a) in INFIX and INFIX[self.letter(a)][1] == force:
            left = f"({left})"
        if force >= 7:
            left, right = (f"({s})" if self.letter(k) == "4" or self.part_of(k) else s for k, s in ((a, left), (b, right)))
        else:
            left, right = (self.expr(k) if self.of_me(k) else s for k, s in ((a, left), (b, right)))
        if force >= 8 and self.letter(b) == "I" and not self.built_in(self.nodes[b].head):
            right = f"({right})"
        if n.letter in "CDE":
            left, right = (f"({self.expr(k)})" if self.letter(k) == "c" else s for k, s in ((a, left), (b, right)))
        return f"{left} {sign} {right}"

    def literal(self, ref: int) -> str:
        x = self.x
        if ref in x.empty:
            return "{}"
        if ref < 0:
            return str(x.ints[ref]) if ref in x.ints else self.named(ref) if self.has_name(ref) else f"<ref{ref}>"
        if ref in x.data:
            return described(*x.data[ref])
        if ref in x.reals:
            return real(x.reals[ref]) if self.rebuilt else rounded(x.reals[ref])  # rebuilt source must compile to the same value
        if ref in x.apps:
            name = x.apps[ref].removesuffix(".app")
            return "application " + quoted(name if name in SHIPPED or name in self.known else x.apps[ref])
        if ref in x.old_texts:
            return quoted(x.old_texts[ref])
        kind, held = x.wraps.get(ref, (0, ()))
        if kind == APP_TERM:
            return self.named(ref)
        if kind == OPTIONAL and len(held) >= 5:
            return f"{self.expr(held[2])} : {self.expr(held[4])}"
        if kind == SPECIFIER and len(held) == 2:
            owner = "application " + quoted(x.apps[held[0]].removesuffix(".app")) if held[0] in x.apps else self.literal(held[0]) if held[0] != ref else "«…»"
            return f"{self.named(held[1])} of {owner}"
        text = x.text(ref)
        if text is not None:
            return quoted(text)
        return str(x.ints[ref]) if ref in x.ints else f"<lit{ref}>"

    def items(self, ref: int) -> str:
        rows = ((self.expr(c[0]) if c[0] > 0 else self.named(c[0]) if self.has_name(c[0]) else "") for c in self.x.chain(ref))
        return ", ".join(rows)

    def arguments(self, ref: int) -> list[str]:
        rows = (self.expr(c[0]) if c[0] > 0 else self.named(c[0]) if c[0] < 0 and self.has_name(c[0]) else "" for c in self.x.chain(ref))
        return [r for r in rows if r]

    def call(self, n: Node, ref: int) -> str:
        if not n.kids:
            return "<call>"
        kind, held = self.x.wraps.get(n.head, (0, ()))
        pushed = 0
        if kind == APP_TERM and len(held) == 2:
            if app := self.app(held[1]):
                self.scopes.append(app)
                pushed = 1
            n = Node(n.letter, n.flags, (held[0], *n.kids[1:]))
        saved = self.labels
        try:
            name = self.named(n.head)
            if not self.built_in(n.head):
                between = self.spread(n) if ref in self.aimed else None
                return between if between is not None else name + self.user_arguments(n)
            event = self.x.events[n.head]
            self.labels = {v.lower() for d in self.dictionaries() for k, v in d.labels.items() if k.startswith(event + "/")}
            direct, rest = self.command_parts(n)
            both = " ".join(s for s in (direct, rest) if s)
            if not both:
                return name
            if n.flags & 3 == 3:
                return f"{direct} {name} {rest}" if direct and rest else f"{both} {name}"
            return f"{name} of {both}" if n.flags & ALT else f"{name} {both}"
        finally:
            self.labels = saved
            del self.scopes[len(self.scopes) - pushed :]

    def command_parts(self, n: Node) -> tuple[str, str]:
        event, direct = self.x.events.get(n.head, ""), ""
        if d := n.kid(1):
            if d in self.nodes:
                direct = self.inner(d)
                if self.letter(d) == "6" or self.letter(d) == "c" and "as" in self.labels:
                    direct = f"({direct})"
            else:
                direct = ", ".join(self.arguments(d))
        cells = list(self.x.chain(n.kid(2), 3))
        labels = [self.label(event, c[0]) for c in cells]
        given, yes, no, parts, open_ended = [], [], [], [], {}
        for label, (key, value, _) in zip(labels, cells):
            truth = self.truth(value)
            if truth:
                (yes if truth == "true" else no).append(label)
            elif key in self.x.names:
                given.append(f"{self.named(key)}:{self.inner(value)}")
            elif label.startswith("«"):
                given.append(f"{label}:{self.inner(value)}")
            else:
                s = self.expr(value)
                if self.bare_of(value) and ("of" in labels or s.startswith(label + " ")) or self.letter(value) == "e":
                    s = f"({s})"
                elif self.command(value) and self.takes_rest(value):
                    open_ended[len(parts)] = (label, s)
                parts.append(f"{label} {s}")
        parts += ["with " + listed(yes)] * bool(yes) + ["without " + listed(no)] * bool(no) + ["given " + ", ".join(given)] * bool(given)
        for k, (label, s) in open_ended.items():
            if k < len(parts) - 1:
                parts[k] = f"{label} ({s})"
        return direct, " ".join(parts)

    def user_arguments(self, n: Node) -> str:
        """The arguments of a handler of the script: in parentheses, after prepositions, or given by label."""
        direct, args = "", []
        if a := n.kid(1):
            if a in self.nodes:
                direct = " of " + self.inner(a)
            else:
                args = self.arguments(a)
        given, yes, no = [], [], []
        for key, value, _ in self.x.chain(n.kid(2), 3):
            truth = self.truth(value)
            if word := PREPOSITIONS.get(self.x.codes.get(key, "")):
                s = self.expr(value)
                direct += f" {word} " + (f"({s})" if self.command(value) and self.takes_rest(value) else s)
            elif truth:
                (yes if truth == "true" else no).append(self.named(key))
            else:
                given.append(f"{self.named(key)}:{self.inner(value)}")
        out = direct if direct else f"({', '.join(args)})" if args or not (given or yes or no) else ""
        return out + (" with " + listed(yes) if yes else "") + (" without " + listed(no) if no else "") + (" given " + ", ".join(given) if given else "")

    def wrapper(self, n: Node, ref: int) -> str:
        if not n.first:
            return "()"
        before = n.flags & CONTINUED and not n.flags & POSSESSIVE
        self.breaks += bool(before)
        s = self.expr(n.first)
        self.breaks -= bool(before)
        s = ("the " if n.flags & THE else "") + s
        s = f"({s})" if n.flags & PARENS else s
        return self.mark() + s if before else s + self.mark() if n.flags & CONTINUED else s

    def mark(self) -> str:
        """A line break of the source, to be laid out when its line's indent is known."""
        return BREAK + chr(ord("0") + self.breaks + 1)

    def negation(self, n: Node, ref: int) -> str:
        held = self.nodes.get(n.kid(0))
        if held and len(held.kids) == 2 and held.letter in "CDE":
            a, b = held.kids
            if held.letter == "E":
                a, b, verb = (b, a, "is not in") if held.flags & ALT else (a, b, "does not contain")
            else:
                verb = "does not end with" if held.letter == "D" else "does not begin with" if held.flags == 0x100 else "does not start with"
            force = INFIX[held.letter][1]
            return f"{self.mine_or(a, force)} {verb} {self.mine_or(b, force + 1)}"
        return "not " + self.mine_or(n.kid(0), NOT)

    def minus(self, n: Node, ref: int) -> str:
        k = n.kid(0)
        return f"-({self.expr(k)})" if self.part_of(k) or self.letter(k) == "I" else "-" + self.sub(k, ATOM)

    def coercion(self, n: Node, ref: int) -> str:
        return f"{self.mine_or(n.kids[0], AS)} as {self.expr(n.kids[1])}" if len(n.kids) > 1 else "<as>"

    def part(self, n: Node, ref: int) -> str:
        if len(n.kids) < 2:
            return "<of>"
        what, owner = n.kids[:2]
        own, of = self.nodes.get(what), self.nodes.get(owner)
        if n.flags & (POSSESSIVE | ALT):
            self.aim(what)
        if n.flags & ALT and self.letter(self.past_break(owner)) == "f":
            closed = own is not None and (own.letter in INFIX or own.letter == "n" and self.spread_call(own.head))
            saved, self.in_my = self.in_my, closed
            s = self.expr(what)
            self.in_my = saved
            return f"my ({s})" if closed else f"my {s}"
        if n.flags & POSSESSIVE:
            if of and of.letter == "g" and n.flags & IMPLICIT:
                code = self.x.codes.get(own.head) if own else None
                s = self.expr(what)
                is_class = any(code in d.classes for d in self.dictionaries() if d is not self.common)
                return f"its {s}" if is_class or s.startswith("«") else s
            if of and of.letter == "g":
                return ("it's " if n.flags & ALT else "its ") + self.expr(what)
            saved, self.in_my = self.in_my, False
            s = self.expr(owner)
            self.in_my = saved
            target = self.nodes.get(self.bare(what))
            calls = target is not None and target.letter == "I" and not self.built_in(target.head)
            if of and (of.letter == "c" or of.letter in INFIX or self.command(owner) or self.part_of(owner) and not of.flags & POSSESSIVE and calls):
                s = f"({s})"
            elif of and not saved and of.letter != "l" and self.ends_spread(owner):
                s = f"({s})"
            return f"{s}'s {self.expr(what)}"
        if own and own.letter in "89":
            words = (("front of", "back of") if own.flags & THE else ("before", "after"))[own.letter == "9"]
            prefix = self.named(own.head, "class") + " " if self.x.codes.get(own.head, "insl") != "insl" else ""
            return f"{prefix}{words} {self.expr(owner)}"
        s = self.expr(owner)
        if self.command(owner) or self.labelled(owner) or self.ends_spread(owner) or of and (of.letter in "c6N" or of.letter in INFIX):
            s = f"({s})"
        first = self.named(own.head, "property") if own and own.letter == "m" and own.head in self.x.codes else self.expr(what)
        return f"{first} {'in' if n.flags & THE else 'of'} {s}"

    def element(self, n: Node, ref: int) -> str:
        if len(n.kids) < 2:
            return "<elem>"
        kind, which = n.kids[:2]
        lit = self.nodes.get(which)
        number = self.x.ints.get(lit.head) if lit and lit.letter == "m" else None
        name = self.named(kind, "class")
        if number is not None:
            if n.flags & POSSESSIVE and number > 0:
                return f"{ordinal(number)} {name}"
            word = ({1: "front", -1: "back"} if n.flags & THE else COUNTED).get(number) if n.flags & (ALT | THE) else None
            if word:
                return f"{word} {name}"
        if self.x.codes.get(kind) == "****":
            name = "any"
        return f"{name} ({self.expr(which)})" if self.part_of(which) else f"{name} {self.sub(which, ATOM)}"

    def bound(self, ref: int, kind: int) -> str:
        n = self.nodes.get(ref)
        if n and n.letter == "4" and not n.flags and len(n.kids) == 2 and self.x.codes.get(n.head, "") == self.x.codes.get(kind):
            ref = n.kids[1]
            n = self.nodes.get(ref)
        if self.of_me(ref) and self.letter(n.head) != "I":
            return self.expr(ref)
        return f"({self.expr(ref)})" if self.part_of(ref) or self.labelled(ref) else self.sub(ref, ATOM)

    def interval(self, n: Node, ref: int) -> str:
        if len(n.kids) < 3:
            return "<range>"
        kind, a, b = n.kids[:3]
        name = self.plural(kind).replace("every «", "«", 1)
        numbers = all((m := self.nodes.get(k)) and m.letter == "m" and m.head in self.x.ints for k in (a, b))
        if not n.flags & THE and not numbers:
            return f"{name} from {self.sub(a, ATOM)} to {self.sub(b, ATOM)}"
        return f"{name} {self.bound(a, kind)} {'through' if n.flags & ALT else 'thru'} {self.bound(b, kind)}"

    def by_key(self, n: Node, ref: int) -> str:
        if len(n.kids) < 2:
            return "<by-id>"
        form = {"name": "named", "indx": "index"}.get(self.x.codes.get(n.kids[2], ""), "id") if len(n.kids) > 2 else "id"
        value = f"({self.expr(n.kids[1])})" if self.part_of(n.kids[1]) else self.sub(n.kids[1], ATOM)
        return f"{self.named(n.head, 'class')} {form} {value}"

    def every(self, n: Node, ref: int) -> str:
        return "every <>" if not n.kids else self.plural(n.head) if n.flags & ALT else "every " + self.named(n.head, "class")

    def filtered(self, n: Node, ref: int) -> str:
        word = "where" if n.flags & ALT else "that" if n.flags & POSSESSIVE else "whose"
        return f"{self.expr(n.kids[0])} {word} {self.expr(n.kids[1])}" if len(n.kids) > 1 else "<filter>"

    def record(self, n: Node, ref: int) -> str:
        return "{" + ", ".join(f"{self.named(k)}:{self.expr(v)}" for k, v, _ in self.x.chain(n.kid(0), 3)) + "}"

    def reference(self, n: Node, ref: int) -> str:
        s = self.expr(n.kid(0))
        return f"a reference to ({s})" if self.letter(n.kid(0)) == "6" else f"a reference to {s}"

    def passed_on(self, n: Node, ref: int) -> str:
        self.aim(n.kid(0))
        return "continue " + self.expr(n.kid(0))

    # --- statements ----------------------------------------------------------------------------

    def lines(self, ref: int, depth: int) -> list[str]:
        """A block's statements, or a statement that stands for a block."""
        n = self.nodes.get(ref)
        if n is None:
            return []
        if n.letter != "k":
            alone = n.letter == "l" and (n.flags & THE or self.continued(n))
            return ["\t" * depth + self.expr(ref)] if alone else self.statement(ref, depth)
        return [line for c in self.x.chain(n.kid(0)) if c[0] > 0 for line in self.statement(c[0], depth)]

    def continued(self, n: Node) -> bool:
        held = self.nodes.get(n.head)
        return bool(held and n.flags & CONTINUED and held.letter == "l" and held.flags & CONTINUED and n.kid(1) == 0)

    def statement(self, ref: int, depth: int) -> list[str]:
        key = ("s", ref)
        if self.depth > DEEPEST or key in self.busy:
            return ["-- (damaged file: cyclic statement)"]
        n = self.nodes.get(ref)
        if n is None:
            return []
        self.busy.add(key)
        self.depth += 1
        try:
            how = STATEMENTS.get(n.letter)
            made = how(self, n, ref, depth) if how else self.value(ref)
            return made if isinstance(made, list) else ["\t" * depth + made]
        finally:
            self.depth -= 1
            self.busy.discard(key)

    def value(self, ref: int) -> str:
        """An expression that is or ends a statement."""
        s, n = self.expr(ref), self.nodes.get(ref)
        if n and self.loops and (n.letter == "6" or n.letter == "n" and n.flags & (POSSESSIVE | ALT) and self.spread_call(n.head)):
            return f"({s})"
        return s

    def note(self, n: Node) -> str:
        """The comment of a source line."""
        style, text = n.flags & 7, self.x.old_texts.get(n.kid(1))
        if n.kid(2) and (wide := self.x.text(n.kid(2))) is not None:
            text = wide
        if text is None:
            if n.flags & CONTINUED:
                return ""
            return "#" if style in (6, 7) else "--" if style == 1 or style == 3 and n.kid(0) else ""
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        return "#" + text if style in (6, 7) else f"(*{text}*)" if style in (0, 4) else "--" + text

    def line(self, n: Node, ref: int, depth: int):
        held = self.nodes.get(n.kid(0))
        closed = n.flags & PARENS and n.kid(1) not in self.x.old_texts
        if held and closed and (held.letter not in STATEMENTS or held.letter == "I") or self.continued(n):
            return self.expr(ref)
        out: list[str] = []
        if n.kid(0):
            inner_closed = held and held.letter == "l" and held.flags & PARENS and held.kid(1) not in self.x.old_texts
            out = ["\t" * depth + self.value(n.kid(0))] if held and (held.letter not in STATEMENTS or inner_closed) else self.statement(n.kid(0), depth)
        if ref in self.moved:
            return out
        if note := self.note(n):
            return out[:-1] + [out[-1] + " " + note] if out else note
        return out or ["\t" * depth]

    def header(self, head: str, ref: int) -> str:
        """A compound statement's first line, with the comment that the compiler kept in its block."""
        first = ref
        if self.letter(ref) == "k":
            cell = self.x.cells.get(self.nodes[ref].kid(0), ())
            if len(cell) != 2:
                return head
            first = cell[0]
        n = self.nodes.get(first)
        if n and n.letter == "l" and n.flags & 7 in (3, 4, 7) and (note := self.note(n)):
            self.moved.add(first)
            return f"{head} {note}"
        return head

    def compound(self, depth: int, head: str, ref: int, end: str) -> list[str]:
        pad = "\t" * depth
        return [self.header(pad + head, ref), *self.lines(ref, depth + 1), f"{pad}end {end}"]

    def handler(self, n: Node, ref: int, depth: int) -> list[str]:
        sign = self.nodes.get(n.head)
        if len(n.kids) < 2 or sign is None or sign.letter != "I" or not sign.kids:
            return ["\t" * depth + "-- incomplete handler"]
        word, name, end = "to" if n.flags & THE else "on", self.named(sign.head), None
        if self.built_in(sign.head):
            parts = " ".join(s for s in self.command_parts(sign) if s)
            head = name + (" of" if parts and sign.flags & ALT else "") + (f" {parts}" if parts else "")
        elif (between := self.spread(sign)) is not None:
            head, end = between, "".join(self.segment(p) + ":" for p in self.x.names[sign.head][:-1].split("_"))
        else:
            head = name + self.user_arguments(sign)
        return self.compound(depth, f"{word} {head}", n.kids[1], end or name)

    def one_line(self, head: str, word: str, ref: int, depth: int) -> list[str] | None:
        """A statement after to or then on the same line, or None if it needs a block."""
        n = self.nodes.get(ref)
        broken = bool(n and n.letter == "l" and n.flags & CONTINUED)
        self.breaks += broken
        inner = self.statement(ref, 0)
        self.breaks -= broken
        pad = "\t" * depth
        if len(inner) == 1:
            return [f"{pad}{head} {word}{self.mark() if broken else ' '}{inner[0]}"]
        if n and n.letter != "k" and inner:
            if broken:
                return [f"{pad}{head} {word} ¬", *self.statement(ref, depth + 1)]
            inner = self.statement(ref, depth)
            return [f"{pad}{head} {word} {inner[0].lstrip(chr(9))}", *inner[1:]]
        return None

    def tell(self, n: Node, ref: int, depth: int) -> list[str]:
        if len(n.kids) < 2:
            return ["\t" * depth + "-- tell (incomplete)"]
        target, t = self.expr(n.kids[1]), self.nodes.get(n.kids[1])
        far = t
        for _ in range(64):
            if not (far and far.letter == "n" and far.flags & POSSESSIVE):
                break
            far = self.nodes.get(far.head)
        spread = far is not None and far.letter == "I" and self.spread(far) is not None
        if t and (t.letter == "6" or self.command(n.kids[1]) or spread or self.labelled(n.kids[1])):
            target = f"({target})"
        app = self.app(n.kids[1])
        self.scopes += [app] * bool(app)
        try:
            if n.flags & ALT:
                self.aim(n.head)
                if made := self.one_line(f"tell {target}", "to", n.head, depth):
                    return made
            return self.compound(depth, f"tell {target}", n.head, "tell")
        finally:
            del self.scopes[len(self.scopes) - bool(app) :]

    def condition(self, n: Node, ref: int, depth: int) -> list[str]:
        pad = "\t" * depth
        if len(n.kids) < 2:
            return [pad + "-- if (incomplete)"]
        head = "if " + self.expr(n.head)
        if n.flags & ALT and (made := self.one_line(head, "then", n.kids[1], depth)):
            return made
        out = [self.header(f"{pad}{head} then", n.kids[1]), *self.lines(n.kids[1], depth + 1)]
        chain = list(self.x.chain(n.kid(2)))
        for (test, _), (then, _) in zip(chain[::2], chain[1::2]):
            out += [self.header(f"{pad}else if {self.expr(test)} then", then), *self.lines(then, depth + 1)]
        if n.kid(3):
            out += [self.header(pad + "else", n.kid(3)), *self.lines(n.kid(3), depth + 1)]
        return [*out, pad + "end if"]

    def repeat(self, n: Node, ref: int, depth: int) -> list[str]:
        head = "repeat"
        if n.letter == "U":
            head += f" {self.expr(n.kid(1))} times"
        elif n.letter in "VW":
            head += f" {'while' if n.letter == 'V' else 'until'} {self.expr(n.kid(1))}"
        elif n.letter == "X" and len(n.kids) > 2:
            s = self.expr(n.kids[2])
            head += f" with {self.named(n.kids[1])} in " + (f"({s})" if self.letter(n.kids[2]) in ("e", "6") else s)
        elif n.letter == "Y" and len(n.kids) > 3:
            head += f" with {self.named(n.kids[1])} from {self.expr(n.kids[2])} to {self.expr(n.kids[3])}" + (f" by {self.expr(n.kid(4))}" if n.kid(4) else "")
        pad = "\t" * depth
        first = self.header(pad + head, n.kid(0))
        self.loops += n.letter in "XY"
        inside = self.lines(n.kid(0), depth + 1)
        self.loops -= n.letter in "XY"
        return [first, *inside, pad + "end repeat"]

    def failure(self, n: Node) -> str:
        parts = ["error", self.inner(n.kid(1))] if n.kid(1) else ["error"]
        return " ".join(parts + [f"{self.label('ascrerr ', k)} {self.inner(v)}" for k, v, _ in self.x.chain(n.kid(2), 3)])

    def attempt(self, n: Node, ref: int, depth: int) -> list[str]:
        pad = "\t" * depth
        out = [self.header(pad + "try", n.kid(0)), *self.lines(n.kid(0), depth + 1)]
        spec = self.nodes.get(n.kid(1))
        if spec and spec.letter == "R":
            clause = self.failure(spec)
            if n.kid(2) or clause != "error":
                out.append(self.header(f"{pad}on {clause}", n.kid(2)))
        return [*out, *self.lines(n.kid(2), depth + 1), pad + "end try"]

    def considering(self, n: Node, ref: int, depth: int) -> list[str]:
        minded, ignored = self.arguments(n.kid(1)), self.arguments(n.kid(2))
        words = ["considering " + listed(minded)] * bool(minded)
        if ignored:
            words.append(("but ignoring " if words else "ignoring ") + listed(ignored))
        head = " ".join(words) or "considering"
        return self.compound(depth, head, n.kid(0), head.split()[0])

    def using(self, n: Node, ref: int, depth: int) -> list[str]:
        head, app = "using terms from " + self.expr(n.kid(1)), self.app(n.kid(1))
        self.scopes += [app] * bool(app)
        try:
            return self.compound(depth, head, n.kid(0), "using terms from")
        finally:
            del self.scopes[len(self.scopes) - bool(app) :]

    def use(self, n: Node, ref: int, depth: int) -> str:
        out = "use " + (self.named(n.head) + " : " if n.head < 0 and self.has_name(n.head) else "") + self.expr(n.kid(1))
        for key, value, _ in self.x.chain(n.kid(2), 3):
            label = dict(impt="importing", minv="version").get(self.x.codes.get(key, "")) or self.named(key)
            truth = self.truth(value)
            out += f" {'with' if truth == 'true' else 'without'} {label}" if truth else f" {label} {self.inner(value)}"
        return out

    def timeout(self, n: Node, ref: int, depth: int) -> list[str]:
        seconds = self.inner(n.kid(1))
        return self.compound(depth, f"with timeout of {seconds} second{'s' * (seconds != '1')}", n.kid(0), "timeout")

    def whole(self) -> str:
        """The script's text."""
        kind, held = self.x.wraps.get(0, (0, ()))
        first = next(iter(self.nodes), 0)
        out = self.lines(held[1], 0) if len(held) > 1 and held[1] > 0 else self.lines(first, 0) if self.letter(first) == "k" else []
        if not out:
            out = next((made for ref, n in self.nodes.items() if n.letter == "k" and n.head > 0 and (made := self.lines(ref, 0))), [])
        text = [line for x in out for line in laid_out(x)]
        while text and not text[-1].strip():
            text.pop()
        return "".join(line + "\n" for line in text)


def laid_out(line: str) -> list[str]:
    """A line cut at the breaks of the source, each followed by its level's indent."""
    first, *rest = line.split(BREAK)
    if not rest:
        return [line]
    base = line[: len(line) - len(line.lstrip("\t"))]

    def cut(s: str) -> str:
        s = s.rstrip(" ")
        tail = s.lstrip("\t")[-1:]
        return s + ("¬" if tail in ("", ":", "{", "[", "(") else " ¬")

    parts = [base + "\t" * (ord(p[0]) - ord("0")) + p[1:].lstrip(" ") if p else base for p in rest]
    return [cut(s) for s in [first, *parts[:-1]]] + parts[-1:]


EXPRESSIONS: dict[str, Callable[[Printer, Node, int], str]] = {
    "o": lambda p, n, r: p.named(n.head) if n.kids else "<var>", "m": lambda p, n, r: p.literal(n.head) if n.kids else "<lit>", "I": Printer.call, "l": Printer.wrapper, "H": Printer.negation,
    "d": Printer.minus, "c": Printer.coercion, "n": Printer.part, "r": lambda p, n, r: p.expr(n.kid(0)), "1": lambda p, n, r: p.named(n.head) if n.kids else "<ref>", "2": Printer.every,
    "3": lambda p, n, r: "some " + p.named(n.head, "class"), "<": lambda p, n, r: "middle " + p.named(n.head, "class"), "4": Printer.element, "7": Printer.interval, "5": Printer.by_key,
    ";": lambda p, n, r: "back" if n.flags & THE else "end", ":": lambda p, n, r: "front" if n.flags & THE else "beginning", "f": lambda p, n, r: "me", "g": lambda p, n, r: "it",
    "M": Printer.passed_on, "e": lambda p, n, r: "get " + p.expr(n.kid(0)), "N": Printer.reference, "6": Printer.filtered, "J": lambda p, n, r: "{" + p.items(n.kid(0)) + "}",
    "v": lambda p, n, r: "[" + p.items(n.kid(0)) + "]", "K": Printer.record,
    "O": lambda p, n, r: f"(tell {p.expr(n.kid(1))} to {p.expr(n.kid(0))})", "~": lambda p, n, r: f"{p.expr(n.kid(0))} : {p.expr(n.kid(1))}",
}

STATEMENTS: dict[str, Callable] = {
    "l": Printer.line, "i": Printer.handler, "j": lambda p, n, r, d: f"property {p.named(n.head)} : {p.expr(n.kids[1])}" if len(n.kids) > 1 else "-- property (incomplete)",
    "p": lambda p, n, r, d: "global " + ", ".join(p.arguments(n.kid(0))), "q": lambda p, n, r, d: "local " + ", ".join(p.arguments(n.kid(0))), "x": Printer.use, "R": lambda p, n, r, d: p.failure(n),
    "t": Printer.timeout, "w": Printer.using, "u": lambda p, n, r, d: p.compound(d, "with transaction" + (" " + p.expr(n.kid(1)) if n.kid(1) else ""), n.kid(0), "transaction"),
    "h": lambda p, n, r, d: p.compound(d, "script" + (" " + p.named(n.head) if p.has_name(n.head) else ""), n.kid(1), "script"), "P": Printer.considering,
    "r": lambda p, n, r, d: f"set {p.expr(n.kids[1])} to {p.value(n.kids[0])}" if len(n.kids) > 1 else "-- set (incomplete)",
    "s": lambda p, n, r, d: f"copy {p.inner(n.kids[0])} to {p.expr(n.kids[1])}" if len(n.kids) > 1 else "-- copy (incomplete)",
    "L": lambda p, n, r, d: "return " + p.value(n.kid(0)) if n.kid(0) else "return", "S": lambda p, n, r, d: "exit repeat", "Z": Printer.condition, "O": Printer.tell, "Q": Printer.attempt,
    **dict.fromkeys("TUVWXY", Printer.repeat), "I": lambda p, n, r, d: p.call(n, r), "k": lambda p, n, r, d: p.lines(r, d),
}


def decompile(b: bytes, dictionaries: dict[str, Dictionary] | None = None, encoding: str | None = None) -> str:
    """The source of a script: compiled, JavaScript, or text already. encoding: of old strings, instead of the one they show."""
    if b.startswith(b"JsOsaDAS"):
        return jxa(b)
    if not fasd_header(b) and b and is_plain(b) and not b.startswith(b"#!"):
        try:
            body(b)
        except Damaged:
            return b.decode("utf-8")
    version, rest = body(b)
    if version < "0.98":
        raise Damaged(f"a script of version {version}, whose dialect isn't read")
    try:
        rows = records(rest)
    except Damaged:  # what can be told of the tree; its bytecode is lost
        rows = tolerant(rest)
        with reading(rows, encoding):
            return Printer(Index(rows), dictionaries).whole()
    if Graph(rows).run_only():
        from palimpsest.functions.rebuild import HEADING, from_bytecode

        return HEADING + from_bytecode(b, dictionaries, encoding)
    with reading(rows, encoding):
        return Printer(Index(rows), dictionaries).whole()
