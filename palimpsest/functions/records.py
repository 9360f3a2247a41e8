"""Compiled scripts: object records, the graph that they make, decoded values, handlers and instructions."""

from __future__ import annotations

import re
import struct
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

from palimpsest.functions.encodings import ROMAN, decode_or_roman, detect
from palimpsest.functions.forks import fasd_header, is_plain, roman, script_resource, unwrap

END = b"\xfa\xde\xde\xad"

#: record type -> (name, has a kind byte, payload): bytes, long bytes, refs, node or none
LAYOUT = {
    0x01: ("symbol", False, "bytes"), 0x02: ("list", False, "refs"), 0x03: ("fixnum", False, "none"), 0x04: ("vector", True, "refs"),
    0x06: ("binding", False, "refs"), 0x07: ("long", False, "bytes"), 0x08: ("float", False, "bytes"), 0x09: ("bool", False, "none"),
    0x0A: ("code", True, "bytes"), 0x0B: ("name", True, "bytes"), 0x0C: ("string", False, "bytes"), 0x0D: ("node", True, "node"),
    0x0E: ("vector", True, "refs"), 0x0F: ("data", True, "bytes"), 0x10: ("pointers", False, "refs"), 0x11: ("raw", False, "bytes"),
    0x12: ("data", True, "long"), 0x13: ("raw", False, "long"),
}


@dataclass
class Record:
    pos: int
    typ: int
    ref: int
    size: int
    kind: int | None = None
    flags: int | None = None
    start: int | None = None
    end: int | None = None
    refs: tuple[int, ...] = ()
    data: bytes = b""


class Damaged(ValueError):
    pass


def body(b: bytes) -> tuple[str, bytes]:
    """Version and records of a compiled script, in whatever wrapper."""
    if b.startswith(b"#!"):
        rest = re.sub(rb"\A#![^\n\r]*[\n\r]", b"", b)
        b = rest if fasd_header(rest) else b
    if not fasd_header(b):
        f = unwrap(b)
        inner = script_resource(b) or (f and (f.data if fasd_header(f.data) else script_resource(f.rsrc)))
        b = inner or b
    n = fasd_header(b)
    if not n:
        raise Damaged("plain text, not compiled" if is_plain(b) else "not a compiled script")
    cut = b.rfind(END)
    if cut >= 0:
        b = b[: cut + 4]
    if len(b) < n + 12:
        raise Damaged("the file is cut short")
    rest = b[n:]
    if b.endswith(END):
        (tail,) = struct.unpack_from(">H", b, len(b) - 6)
        if 0 < tail <= len(rest):
            rest = rest[:-tail]
    return b[8:12].decode(), rest


def one(b: bytes, pos: int) -> tuple[Record, int]:
    """The record at pos, and where the next is; Damaged if there is none."""
    at = pos

    def take(size: int) -> bytes:
        nonlocal at
        if at + size > len(b):
            raise Damaged(f"a record at {pos} is cut short")
        at += size
        return b[at - size : at]

    typ = take(1)[0]
    ref, size = struct.unpack(">hH", take(4))
    if typ not in LAYOUT:
        raise Damaged(f"unknown record {typ:#x} at {pos}")
    _, has_kind, payload = LAYOUT[typ]
    r = Record(pos, typ, ref, size, take(1)[0] if has_kind else None)
    if payload == "node":
        r.flags, r.start, r.end = struct.unpack(">HHH", take(6))
    if payload in ("refs", "node"):
        r.refs = struct.unpack(f">{size}h", take(2 * size))
    elif payload == "bytes":
        r.data = take(size)
    elif payload == "long":
        r.data = take(int.from_bytes(take(4), "big"))
    return r, at


def records(b: bytes) -> list[Record]:
    """All records, in order; Damaged at the first that isn't one."""
    out, at = [], 0
    while at < len(b):
        r, at = one(b, at)
        out.append(r)
    return out


@dataclass(frozen=True)
class Code:
    """A term: of a class or constant, or an event of eight characters."""

    code: str
    event: bool = False

    def __str__(self) -> str:
        return f"«event {self.code}»" if self.event else f"«class {self.code}»"


@dataclass
class Vector:
    kind: int
    items: list[Any]

    def __str__(self) -> str:
        return f"block{self.kind}{{{', '.join(map(shown, self.items))}}}"


@dataclass
class Binding:
    pairs: list[tuple[Any, Any]] = field(default_factory=list)

    def __str__(self) -> str:
        return "{" + ", ".join(f"{shown(k)}:{shown(v)}" for k, v in self.pairs) + "}"


class Text(str):
    pass


def quoted(s: str) -> str:
    s = s.replace("\\", "\\\\").replace('"', '\\"').replace("\r\n", "\n").replace("\r", "\n")
    return f'"{s}"'


def shown(v: Any) -> str:
    """A value as the listing has it."""
    if v is None:
        return "nil"
    if isinstance(v, Text):
        return quoted(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return real(v)
    if isinstance(v, bytes):
        return f"<{len(v)} bytes>"
    if isinstance(v, list):
        return f"[{', '.join(map(shown, v))}]"
    return str(v)


def real(x: float) -> str:
    """A real as scripts print it: decimal between a thousandth and ten thousand, else with an exponent."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "INF", "-inf": "-INF"}[str(x)]
    if x == 0 or 1e-3 < abs(x) < 1e4:
        text = f"{x:.17f}".rstrip("0") if "e" in repr(x) else repr(x)
        return text + "0" if text.endswith(".") else text
    digits, _, power = f"{x:e}".partition("e")
    shortest = repr(x)
    m = re.fullmatch(r"(-?)(\d+)(?:\.(\d+))?(?:e([+-]\d+))?", shortest)
    whole, part = m[2], m[3] or ""
    significant = (whole + part).lstrip("0").rstrip("0") or "0"
    return f"{m[1]}{significant[0]}.{significant[1:] or '0'}E{int(power):+d}"


MAX_DEPTH, MAX_CHAIN, MAX_HANDLERS = 256, 100_000, 10_000


#: The encoding of a script's old byte strings, while it is being read.
_READING: ContextVar[str] = ContextVar("reading", default=ROMAN)
_CHEVRONS = ("«class ", "«event ", "«constant ", "«data ")


def old_text(b: bytes) -> str:
    """A byte string of an old script, in the encoding that the script is read in."""
    name = _READING.get()
    return roman(b) if name == ROMAN else decode_or_roman(b, name)


def old_strings(rows: list[Record]) -> list[bytes]:
    """The byte strings that old systems stored in their own encoding: strings, and names that aren't UTF-8."""
    out = []
    for r in rows:
        if r.typ == 0x0C and r.data:
            n = int.from_bytes(r.data[:2], "big")
            out.append(r.data[2 : 2 + n])
        elif r.typ == 0x0B and r.data:
            out += [x for x in spellings(r.data) if not is_utf8(x)]
    return out


def script_encoding(rows: list[Record]) -> str:
    """The encoding of a script's old strings, which it doesn't tell. Codes in chevrons force Mac Roman:
    read as Japanese, a chevron's byte pairs up with the next."""
    texts = old_strings(rows)
    if any(c in roman(t) for t in texts for c in _CHEVRONS):
        return ROMAN
    return detect(texts)


@contextmanager
def reading(rows: list[Record], encoding: str | None = None):
    """Old strings are read in the encoding given, else in the one that they show."""
    token = _READING.set(encoding or script_encoding(rows))
    try:
        yield
    finally:
        _READING.reset(token)


def is_utf8(b: bytes) -> bool:
    try:
        b.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def spellings(data: bytes) -> list[bytes]:
    """The byte strings in an identifier's record: lengths of two bytes, then the characters."""
    out, at = [], 0
    while at + 2 <= len(data):
        (n,) = struct.unpack_from(">H", data, at)
        part = data[at + 2 : at + 2 + n]
        if not n or len(part) < n:
            break
        out.append(part)
        at += 2 + n
    return out


def names(data: bytes) -> list[str]:
    """The spellings in an identifier's record."""
    return [x.decode("utf-8") if is_utf8(x) else old_text(x) for x in spellings(data)]


class Graph:
    """The objects of one script by reference, and their values."""

    def __init__(self, rows: list[Record]):
        self.by_ref = {r.ref: r for r in rows}
        self._made: dict[int, Any] = {}

    def value(self, ref: int, depth: int = 0) -> Any:
        if ref not in self._made:
            self._made[ref] = None  # on a cycle
            self._made[ref] = self._decode(self.by_ref.get(ref), depth)
        return self._made[ref]

    def _decode(self, r: Record | None, depth: int) -> Any:
        if r is None or depth > MAX_DEPTH:
            return None
        what, down = LAYOUT[r.typ][0], depth + 1
        if what == "fixnum":
            return r.size - 0x10000 if r.size & 0x8000 else r.size
        if what == "bool":
            return r.size != 0
        if what == "long" and len(r.data) == 4:
            return struct.unpack(">i", r.data)[0]
        if what == "float" and len(r.data) == 8:
            return struct.unpack(">d", r.data)[0]
        if what == "name":
            spelt = names(r.data)
            return next((s for s in spelt if s != s.lower()), spelt[0] if spelt else None)
        if what == "code":
            if len(r.data) == 4:
                return Code(roman(r.data))
            if len(r.data) >= 8 and r.kind == EVENT_KIND:
                return Code(roman(r.data[:8]), event=True)
            if len(r.data) == 8:  # an enumeration and its constant
                return Code(roman(r.data[4:]))
        if what == "string":
            whole = len(r.data) >= 2 and 2 + int.from_bytes(r.data[:2], "big") <= len(r.data)
            return Text(roman(r.data[:2]) + old_text(r.data[2:]) if whole else roman(r.data))
        if what == "raw":
            return r.data
        if what == "list":
            out, cell = [], r
            while cell is not None and cell.typ == r.typ and len(cell.refs) == 2 and len(out) < MAX_CHAIN:
                out.append(self.value(cell.refs[0], down))
                cell = self.by_ref.get(cell.refs[1])
            return out
        if what == "binding":
            made, cell = Binding(), r
            while cell is not None and cell.typ == r.typ and len(cell.refs) == 3 and len(made.pairs) < MAX_CHAIN:
                made.pairs.append((self.value(cell.refs[0], down), self.value(cell.refs[1], down)))
                cell = self.by_ref.get(cell.refs[2])
            return made
        if what == "pointers":
            return [self.value(x, down) for x in r.refs]
        if what == "vector":
            items = [self.value(x, down) for x in r.refs]
            if len(items) == 1 and isinstance(items[0], bytes) and r.kind in TEXT_KINDS:
                return Text(items[0][: len(items[0]) & ~1].decode("utf-16-be", "replace"))
            return Vector(r.kind, items)
        return None

    def handlers(self) -> list[Handler]:
        """The handlers of the root's table, then those nested in literals, breadth first."""
        root = self.value(0)
        if not isinstance(root, Vector) or not root.items or not isinstance(root.items[-1], list):
            return []
        queue = [h for h in map(Handler.of, root.items[-1][2:]) if h]
        k = 0
        while k < len(queue) < MAX_HANDLERS:
            queue += [h for h in map(Handler.of, queue[k].literals) if h]
            k += 1
        return queue[:MAX_HANDLERS]

    def run_only(self) -> bool:
        """Whether the syntax tree was left out: the root's second reference is a symbol."""
        root = self.by_ref.get(0)
        second = self.by_ref.get(root.refs[1]) if root and len(root.refs) > 1 else None
        return second is not None and second.typ == 0x01


#: The kind of a term that is an event.
EVENT_KIND = 0x2E
#: Kinds of vectors of one raw block that hold a text in UTF-16.
TEXT_KINDS = frozenset({0xB1})


@dataclass
class Handler:
    name: Any
    params: list[Any]
    vars: list[str]
    literals: list[Any]
    code: bytes

    @staticmethod
    def of(v: Any) -> Handler | None:
        """Vectors of kind 16 or 17: name, -, parameters, labels, variables, literals, code."""
        if not isinstance(v, Vector) or v.kind not in (16, 17) or len(v.items) < 7:
            return None
        name, _, given, _, own, literals, code = v.items[:7]
        params: list[Any] = []
        if isinstance(given, Vector):
            if given.kind == 123:
                params = [given]
            elif len(given.items) > 1 and isinstance(given.items[1], Vector) and not isinstance(name, Code):
                params = given.items[1].items
        elif isinstance(given, str):
            params = [given]
        spelt = [x if isinstance(x, str) else "" for x in own] if isinstance(own, list) else []
        return Handler(name, params, spelt, literals if isinstance(literals, list) else [], code if isinstance(code, bytes) else b"")


def _operations() -> dict[int, tuple[str, int]]:
    """opcode -> mnemonic and number of operand words."""
    told = """
    00 Equal|01 NotEqual|02 GreaterThan|03 GreaterThanOrEqual|04 LessThan|05 LessThanOrEqual|06 StartsWith|07 EndsWith|08 Contains|09 And 1|0a Or 1|0b Not
    0c MessageSend 1|0d MakeList|0e MakeRecord|0f Return|10 Continue 1|11 ObjectAliasQuote|12 Tell 1|13 Consider 1|14 ErrorHandler 1|15 Error|16 Exit|17 LinkRepeat 1
    18 RepeatNTimes|19 RepeatWhile|1a RepeatUntil|1b RepeatInCollection 1|1c RepeatInRange 1|1d TestIf 1|1e Add|1f Subtract|20 Multiply|21 Divide|22 Quotient
    23 Remainder|24 Power|25 Concatenate|26 Coerce|27 Negate|28 GetData|29 PushMe|2a PushIt|2b PositionalMessageSend 1|45 GetData|46 SetData|47 CopyData
    4a PositionalContinue 1|4b DefineActor 1|4c DefineProcedure 1|4d DefineClosure|4e DefineProperty 1|4f StoreResult|50 GetResult|51 Clone|52 Of|53 EndDefineActor
    54 EndOf|55 EndTell|56 EndConsider|57 EndErrorHandler 1|58 HandleError 2|59 Jump 1|5a Pop|5b Dup|5c GCSwap|5d PushVariableExtended 1|5e PopVariableExtended 1
    5f PushGlobalExtended 1|60 PopGlobalExtended 1|61 PushLiteralExtended 1|62 PushParentVariable 2|63 PopParentVariable 2|64 PushNext|65 PushTrue|66 PushFalse
    67 PushEmpty|68 PushUndefined|69 PushMinus1|6a Push0|6b Push1|6c Push2|6d Push3|6e BeginTimeout|6f EndTimeout|70 BeginTransaction 1|71 EndTransaction
    75 MatchLiteral 1|76 MakeVector"""
    out = {}
    for entry in re.split(r"[|\n]", told):
        if entry.strip():
            op, name, *words = entry.split()
            out[int(op, 16)] = (name, int(words[0]) if words else 0)
    out |= {op: ("MakeObjectAlias", 0) for op in range(0x2C, 0x38)} | {op: ("MakeComp", 0) for op in range(0x38, 0x45)}
    for k, name in enumerate("PushVariable PopVariable PushGlobal PopGlobal PushLiteral PushLiteral".split()):
        out |= {op: (name, 0) for op in range(0xA0 + 16 * k, 0xB0 + 16 * k)}
    return out


OPERATIONS = _operations()
BRANCHES = frozenset("And EndErrorHandler ErrorHandler Jump LinkRepeat Or TestIf".split())


@dataclass
class Instruction:
    off: int
    op: int
    name: str
    args: list[int]
    size: int

    @property
    def target(self) -> int | None:
        """Where a branch leads: its word counts from the byte after the opcode."""
        return self.off + 1 + self.args[0] if self.name in BRANCHES and self.args else None


def instructions(code: bytes) -> tuple[list[Instruction], str]:
    """All instructions up to the end or the first that isn't one, and what was wrong with that."""
    out, at = [], 0
    while at < len(code):
        op = code[at]
        if op not in OPERATIONS:
            return out, f"unknown opcode {op:#x} at {at}"
        name, n = OPERATIONS[op]
        if at + 1 + 2 * n > len(code):
            return out, f"truncated {name} at {at}"
        packed = [op & 0x1F] if op >= 0xE0 else [op & 0x0F] if op >= 0xA0 else [op - 0x2C] if name == "MakeObjectAlias" else [op - 0x38] if name == "MakeComp" else []
        out.append(Instruction(at, op, name, packed + list(struct.unpack_from(f">{n}h", code, at + 1)), 1 + 2 * n))
        at += 1 + 2 * n
    return out, ""


def operands(h: Handler, i: Instruction) -> str:
    """An instruction's operands, with what literals and variables they mean."""
    last = i.args[-1] if i.args else 0
    if i.name.startswith(("PushLiteral", "PushGlobal", "PopGlobal", "MessageSend", "PositionalMessageSend")):
        return f"{last}  ; {shown(h.literals[last]) if 0 <= last < len(h.literals) else f'L{last}?'}"
    if i.name.startswith(("PushVariable", "PopVariable")):
        return f"{last}  ; {h.vars[last] if 0 <= last < len(h.vars) else f'var{last}?'}"
    return " ".join(f"→{i.target:05x}" if k == 0 and i.target is not None else str(a) for k, a in enumerate(i.args))


def disassembly(handlers: list[Handler]) -> str:
    out = []
    for h in handlers:
        params = f"({', '.join(map(shown, h.params))})" if h.params else ""
        out.append(f"handler {shown(h.name)}{params}  vars=[{' '.join(h.vars)}]")
        found, wrong = instructions(h.code)
        out += [f"  {i.off:05x}  {i.name:<22}{operands(h, i)}" for i in found]
        out += [f"  !! {wrong}"] * bool(wrong) + [""]
    return "\n".join(out) + "\n" if out else ""


def tree(rows: list[Record]) -> str:
    """The syntax nodes as an indented tree under each node that no other refers to; what comes
    again is only named."""
    nodes = {r.ref: r for r in rows if r.typ == 0x0D}
    cells = {r.ref: r for r in rows if r.typ in (0x02, 0x06, 0x10) and r.refs}
    held = {x for r in [*nodes.values(), *cells.values()] for x in r.refs}
    graph, out, seen = Graph(rows), [], set()
    todo = [(r.ref, 0) for r in rows if r.typ == 0x0D and r.ref not in held and nodes[r.ref] is r][::-1]
    while todo:
        ref, depth = todo.pop()
        pad = "  " * depth
        if ref in seen and ref > 0:
            out.append(f"{pad}#{ref} (seen)")
            continue
        if ref > 0:
            seen.add(ref)
        if ref > 0 and ref in nodes:
            n = nodes[ref]
            out.append(f"{pad}#{ref} '{chr(n.kind or 0)}' flags={n.flags:#x} pos={n.start}-{n.end} [{' '.join(map(str, n.refs))}]")
        elif ref > 0 and ref in cells:
            out.append(f"{pad}@{ref} list")
        else:
            out.append(f"{pad}{'#' * (ref > 0)}{ref} {shown(graph.value(ref)) if ref in graph.by_ref else ''}".rstrip())
            continue
        todo += [(x, depth + 1) for x in (nodes.get(ref) or cells[ref]).refs[::-1]]
    return "\n".join(out) + "\n" if out else ""


def _displayable(s: str) -> bool:
    """Whether a text looks like one that somebody wrote."""
    return len(s) <= 2000 and not re.search("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x80-\\x9f\\ue000-\\uf8ff\\ufff0-\\uffff]", s)


def plausible(r: Record) -> bool:
    """Whether what was read at some byte is likely a record, and not part of another."""
    what = LAYOUT[r.typ][0]
    if what in ("list", "binding"):
        return r.ref > 0 and 0 < r.size <= 20
    if what == "node":
        return -500 <= r.ref <= 500 and r.size <= 100 and 11 + 2 * r.size <= 300 and 0x20 <= (r.kind or 0) <= 0x7E
    if what == "raw":
        return r.size <= 20000 and r.size % 2 == 0 and _displayable(r.data.decode("utf-16-be", "replace"))
    if what == "name":
        return r.ref < 0 and 0 < r.size <= 512 and r.kind == 0x30
    if what == "code":
        return r.ref < 0 and (len(r.data) == 4 or len(r.data) == 8 or r.kind == EVENT_KIND) and all(c >= 0x20 and c != 0x7F for c in r.data[:8])
    if what == "data":
        return r.ref > 0 and r.size >= 4
    if what == "string":
        return len(r.data) >= 2 and 2 + int.from_bytes(r.data[:2], "big") <= len(r.data) and _displayable(roman(r.data[2:]))
    return what == "fixnum" and r.ref < 0 or what == "long" and r.size == 4 and r.ref < 0 or what == "float" and r.size == 8 and r.ref > 0 or what == "vector" and r.ref >= 0 and 0 < r.size <= 20


def tolerant(b: bytes) -> list[Record]:
    """The records of a damaged script that can be told: read byte by byte where the order is lost. A
    record that is likely one is passed over whole, unless only the strict order would tell it."""
    out, at = [], 0
    while at < len(b):
        if b[at] in LAYOUT:
            try:
                r, end = one(b, at)
            except Damaged:
                at += 1
                continue
            if plausible(r):
                out.append(r)
                at = end
                continue
        at += 1
    return out
