"""Source text of run-only scripts: their bytecode, run on a stack of expressions, gives back a syntax tree.

Each instruction takes expressions from the stack and puts one back, or completes a statement;
branches are told apart by the shapes that the compiler gives to if, repeat, try and tell. The tree
is an Index like that of a script with its own tree, and the same Printer prints it. An instruction
that fits no shape ends the attempt with Unsupported.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from palimpsest.functions.records import Binding, Code, Graph, Handler, Instruction, Record, Text, Vector, body, instructions, reading, records
from palimpsest.functions.source import ALT, IMPLICIT, POSSESSIVE, THE, Dictionary, Index, Node, Printer

HEADING = "-- From run-only bytecode: its comments and layout are lost.\n\n"
BINARY = {
    "Equal": "=", "NotEqual": ">", "GreaterThan": "?", "GreaterThanOrEqual": "@", "LessThan": "A", "LessThanOrEqual": "B", "StartsWith": "C", "EndsWith": "D", "Contains": "E",
    "Add": "[", "Subtract": "\\", "Multiply": "]", "Divide": "^", "Quotient": "_", "Remainder": "`", "Power": "a", "Concatenate": "b", "Coerce": "c",
}
REFERENCES = "n1234567"
#: After these a value that a block leaves isn't an operand.
ENDS = frozenset(
    "BeginTimeout BeginTransaction Consider DefineProcedure Dup EndConsider EndDefineActor EndErrorHandler EndTell EndTimeout EndTransaction ErrorHandler Exit GetResult HandleError Jump "
    "LinkRepeat Pop Return StoreResult Tell".split()
)


class Unsupported(ValueError):
    pass


class App(str):
    pass


@dataclass(frozen=True)
class Described:
    kind: str
    data: bytes


class Values(Graph):
    """A script's values, with applications and descriptors."""

    def __init__(self, rows: list[Record]):
        super().__init__(rows)
        self.index = Index(rows)

    def _decode(self, r: Record | None, depth: int):
        if r is not None and r.ref in self.index.apps:
            return App(self.index.apps[r.ref])
        if r is not None and r.ref in self.index.data:
            return Described(*self.index.data[r.ref])
        return super()._decode(r, depth)


@dataclass
class Item:
    """What the stack holds: an expression, or a mark of the compiler's."""

    ref: int = 0
    count: int = -1  # the number, if it is one
    undefined: bool = False
    it: bool = False
    done: bool = False  # stored by a statement already
    script: bool = False
    following: bool = False  # of a continue
    got: bool = False


class Tree:
    """A syntax tree in the making."""

    def __init__(self, values: Values):
        self.values, self.x = values, Index([])
        self.x.spelling = values.index.spelling
        self.up, self.down = 0, 0
        self.scopes: list[list[str]] = []
        self.declared: set[str] = set()
        self.earlier: set[str] = set()

    def new(self) -> int:
        self.up += 1
        return self.up

    def none(self) -> int:
        """A reference to nothing."""
        self.down -= 1
        return self.down

    def node(self, letter: str, *kids: int, flags: int = 0) -> int:
        ref = self.new()
        self.x.nodes[ref] = Node(letter, flags, kids)
        return ref

    def at(self, ref: int) -> Node:
        return self.x.nodes.get(ref) or Node("", 0, ())

    def chain(self, refs: Iterable[int]) -> int:
        tail = self.none()
        for ref in reversed(list(refs)):
            cell = self.new()
            self.x.cells[cell] = (ref, tail)
            tail = cell
        return tail

    def cells(self, pairs: Iterable[tuple[int, int]]) -> int:
        tail = self.none()
        for key, value in reversed(list(pairs)):
            cell = self.new()
            self.x.cells[cell] = (key, value, tail)
            tail = cell
        return tail

    def name(self, s: str) -> int:
        ref = self.none()
        self.x.names[ref] = s
        return ref

    def term(self, code: str, enum: str = "") -> int:
        ref = self.none()
        self.x.codes[ref] = code
        if enum:
            self.x.enums[ref] = enum
        return ref

    def key(self, v) -> int:
        """A name or term as a label."""
        if isinstance(v, Code):
            if not v.event:
                return self.term(v.code)
            ref = self.none()
            self.x.events[ref] = v.code
            return ref
        return self.name(v if isinstance(v, str) else "<key>")

    def variable(self, v) -> int:
        return self.node("o", self.key(v)) if isinstance(v, (str, Code)) and not isinstance(v, (Text, App)) else self.literal(v)

    def line(self, *kids: int) -> int:
        return self.node("l", *kids, flags=2)

    def literal(self, v) -> int:
        x, ref = self.x, self.new()
        if isinstance(v, bool):
            return self.node("m", self.term("true" if v else "fals", "boov"))
        if isinstance(v, int):
            ref = self.none()
            x.ints[ref] = v
        elif isinstance(v, float):
            x.reals[ref] = v
        elif isinstance(v, Text):
            at = self.new()
            x.texts[at], x.wraps[ref] = str(v), (0xB1, (at,))
        elif isinstance(v, App):
            x.apps[ref] = str(v)
        elif isinstance(v, Described):
            x.data[ref] = (v.kind, v.data)
        elif isinstance(v, Code):
            return self.node("m" if v.event or v.code in ("true", "fals", "msng", "null", "cura") else "1", self.key(v))
        elif isinstance(v, str):
            return self.node("o", self.name(v))
        elif isinstance(v, list):
            return self.node("J", self.chain(map(self.literal, v)))
        elif isinstance(v, Binding):
            return self.node("K", self.cells((self.key(k), self.literal(w)) for k, w in v.pairs))
        elif v is None:
            return self.node("m", self.term("msng"))
        elif isinstance(v, Vector):
            if v.kind == 4 and len(v.items) == 2 and isinstance(v.items[0], int):  # a list that was stored whole
                held = v.items[1].items if isinstance(v.items[1], Vector) else []
                return self.literal(held[: v.items[0]])
            return self.reference(v)
        else:
            raise Unsupported(f"a literal of {type(v).__name__}")
        return self.node("m", ref)

    def reference(self, v: Vector) -> int:
        """A reference that the compiler made: its kind is that of the instruction that would make it, and 21."""
        held, kind, n = v.items, v.kind, len(v.items)
        if kind == 20 and n == 1:
            return self.node("N", self.literal(held[0]))
        if kind == 123 and n == 3:  # a parameter with a class or a value of its own
            p = self.variable(held[0])
            p = self.node("c", p, self.literal(held[1])) if held[1] is not None else p
            return self.node("~", p, self.literal(held[2])) if held[2] is not None else p
        owner = held[0] if held else None
        if kind == 21 and n == 2:
            part = self.node("o" if isinstance(held[1], str) else "1", self.key(held[1]))
            if isinstance(owner, Code) and owner.code == "cura":
                return self.node("n", part, self.literal(owner), flags=POSSESSIVE)
        elif kind in (22, 23) and n == 2:
            part = self.node("2" if kind == 22 else "3", self.key(held[1]))
        elif kind == 24 and n == 3:
            part = self.node("4", self.key(held[1]), self.literal(held[2]))
        elif kind == 25 and n >= 3:
            part = self.node("5", self.key(held[1]), self.literal(held[2]), self.key(held[3]) if n > 3 else self.term("name"))
        elif kind == 27 and n == 4:
            part = self.node("7", self.key(held[1]), self.literal(held[2]), self.literal(held[3]), flags=THE)
        elif kind in (30, 31) and n == 1:
            part = self.node(":" if kind == 30 else ";")
        else:
            raise Unsupported(f"a literal of kind {kind}")
        if owner is None or isinstance(owner, Vector) and owner.kind == 15:
            return part
        if isinstance(owner, Vector) and owner.kind == 20 and len(owner.items) == 1:
            owner = owner.items[0]
        return self.node("n", part, self.literal(owner))

    # --- scripts and handlers --------------------------------------------------------------------

    def script(self, table, top: bool) -> list[int]:
        """The statements of a script object: its names, then its properties, handlers and objects."""
        if not isinstance(table, list) or len(table) == 1:
            raise Unsupported("a script without its table")
        if not table:
            return []
        labels, entries = table[1] if isinstance(table[1], list) else [], table[2:]
        self.scopes.append([n if isinstance(n, str) else str(n) for n in labels])
        saved, self.earlier = self.earlier, set(self.earlier)
        try:
            return self._items(labels, entries, top)
        finally:
            self.earlier = saved
            self.scopes.pop()

    def _items(self, labels: list, entries: list, top: bool) -> list[int]:
        found = [(labels[k] if k < len(labels) else None, e, Handler.of(e)) for k, e in enumerate(entries)]
        used, wanted = self._globals([h for _, _, h in found if h])
        out: list[int] = []
        run: list[int] = []
        if top and wanted:
            self.declared = {w.lower() for w in wanted}
            out.append(self.line(self.node("p", self.chain(self.node("o", self.name(w)) for w in wanted))))
        last = max((k for k, (_, _, h) in enumerate(found) if h), default=-1)
        for k, (label, entry, h) in enumerate(found):
            if h:
                bare = isinstance(h.name, Code) and h.name.code == "aevtoapp" and not h.params and not _pattern(entry)
                if bare and top and k == last:
                    run = self.code(h, entry, "run")
                    if run:
                        continue
                out += [self.handler(h, entry), self.line()]
            elif isinstance(entry, Vector) and entry.kind == 15:
                if len(entry.items) < 4 or top and isinstance(label, str) and label.lower() in used:
                    continue
                inside = self.script(entry.items[3], False)
                out += [self.line(self.node("h", self.key(entry.items[0] if entry.items[0] is not None else label), self.node("k", self.chain(inside)))), self.line()]
            elif isinstance(label, Code) and label.code in ("pimr", "pare") or label is None:
                continue
            elif not (top and isinstance(label, str) and label.lower() in used):  # else a variable's value as it was saved
                self.earlier |= {label.lower()} if isinstance(label, str) else set()
                out.append(self.line(self.node("j", self.key(label), self.literal(entry))))
        if not top and out and not self.at(out[-1]).kids:
            out.pop()
        return out + run

    def _globals(self, handlers: list[Handler]) -> tuple[set[str], list[str]]:
        """Names that handlers reach as globals, and those that need a declaration for it, as they come."""
        used: set[str] = set()
        wanted: dict[str, str] = {}
        for h in handlers:
            for i in instructions(h.code)[0]:
                if i.name.startswith(("PushGlobal", "PopGlobal")) and 0 <= i.args[-1] < len(h.literals):
                    v = h.literals[i.args[-1]]
                    if isinstance(v, str) and not isinstance(v, (Text, App)):
                        used.add(v.lower())
                        if not (isinstance(h.name, Code) and h.name.code == "aevtoapp") and v.lower() not in ("result", "applescript"):
                            wanted.setdefault(v.lower(), v)
        return used, list(wanted.values())

    def handler(self, h: Handler, v: Vector) -> int:
        held = self.node("k", self.chain(self.code(h, v, "handler")))
        params, pattern = [self.variable(p) for p in h.params], _pattern(v)
        pairs = v.items[3].pairs if isinstance(v.items[3], Binding) else []
        labels = self.cells((self.key(k), self.variable(w)) for k, w in pairs) if pairs else self.none()
        if isinstance(h.name, Code):
            direct = self.node("J", self.chain(map(self.variable, pattern))) if pattern is not None else params[0] if params else self.none()
        elif isinstance(v.items[2], str) or isinstance(v.items[2], Vector) and v.items[2].kind == 123:
            direct = params[0]
        else:
            direct = self.chain(params) if params else self.none()
        return self.node("i", self.node("I", self.key(h.name), direct, labels), held)

    def code(self, h: Handler, v: Vector, kind: str) -> list[int]:
        found, wrong = instructions(h.code)
        if wrong:
            raise Unsupported(wrong)
        run = Run(self, h, found)
        out = run.statements(0, len(h.code))
        if len(found) > 2 and found[-1].name == "Return" and run.blank_before(len(found) - 1):
            out.append(self.line())
        declared = run.locals(v, kind == "run")
        return [self.line(self.node("q", self.chain(self.node("o", self.name(d)) for d in declared)))] * bool(declared) + out


def _pattern(v: Vector) -> list | None:
    """The names of a list that a handler takes as its parameter."""
    given, event = v.items[2], isinstance(v.items[0], Code)
    if isinstance(given, list):
        return given
    if event and isinstance(given, Vector) and given.kind != 123 and len(given.items) > 1 and isinstance(given.items[1], Vector):
        return given.items[1].items
    return None


def _count(values: list) -> int:
    """How many variables parameters name, patterns' included."""
    n = 0
    for p in values:
        held = p if isinstance(p, list) else p.items if isinstance(p, Vector) and p.kind == 0 else p.items[1:] if isinstance(p, Vector) and p.kind == 4 else None
        n += 1 if held is None else _count(held)
    return n


class Run:
    """One handler's code on a stack of expressions."""

    def __init__(self, t: Tree, h: Handler, code: list[Instruction]):
        self.t, self.h, self.code = t, h, code
        self.at = {i.off: k for k, i in enumerate(code)} | {len(h.code): len(code)}
        self.blanks: set[int] = set()
        self.stack: list[Item] = []
        self.out: list[int] = []

    # --- helpers -----------------------------------------------------------------------------------

    def literal(self, k: int):
        return self.h.literals[k] if 0 <= k < len(self.h.literals) else None

    def local(self, k: int) -> int:
        held = self.h.vars[k] if 0 <= k < len(self.h.vars) else ""
        return self.t.name(held or f"var{k}")

    def push(self, ref: int, **marks) -> None:
        self.stack.append(Item(ref, **marks))

    def pop(self) -> Item:
        if not self.stack:
            raise Unsupported("an empty stack")
        return self.stack.pop()

    def emit(self, ref: int) -> None:
        self.out.append(self.t.line(ref))

    def value(self, v: Item) -> int:
        """A value that stands alone: an evaluated reference is a get."""
        n = self.t.at(v.ref)
        return self.t.node("e", v.ref) if v.got and n.letter and n.letter in REFERENCES and not (n.letter == "n" and n.flags & ALT) else v.ref

    def label(self, ref: int) -> int:
        n = self.t.at(ref)
        return n.kids[0] if n.letter and n.letter in "1mo" and len(n.kids) == 1 and n.kids[0] < 0 else self.t.name("<key>")

    def arguments(self) -> list[Item]:
        n = self.pop().count
        if not 0 <= n <= len(self.stack):
            raise Unsupported("a count of arguments")
        held = self.stack[len(self.stack) - n :]
        del self.stack[len(self.stack) - n :]
        return held

    def end_of(self, pc: int, opening: str, closing: str) -> int:
        depth = 0
        for k in range(pc + 1, len(self.code)):
            if self.code[k].name == opening:
                depth += 1
            elif self.code[k].name == closing:
                if not depth:
                    return k
                depth -= 1
        raise Unsupported(f"{opening} without {closing}")

    def index(self, off: int) -> int:
        return self.at.get(off, len(self.code))

    def blank_before(self, k: int) -> bool:
        """Whether a block's end keeps the mark of an empty line; each counts once."""
        if k < 2 or self.code[k - 1].name != "GetResult" or self.code[k - 2].name != "StoreResult" or k - 2 in self.blanks:
            return False
        self.blanks.add(k - 2)
        return True

    def within(self, lo: int, hi: int) -> tuple[list[int], list[Item]]:
        """Statements and stack of a range of code, run on a stack of its own."""
        kept = self.out, self.stack
        self.out, self.stack = [], []
        try:
            pc = self.at.get(lo)
            if pc is None:
                raise Unsupported(f"a branch into {lo:#x}")
            while pc < len(self.code) and self.code[pc].off < hi:
                i = self.code[pc]
                how = getattr(self, f"op_{i.name}", None)
                if how is None:
                    raise Unsupported(f"{i.name} at {i.off:#x}")
                after = how(i, pc)
                pc = pc + 1 if after is None else after
            return self.out, self.stack
        finally:
            self.out, self.stack = kept

    def statements(self, lo: int, hi: int) -> list[int]:
        out, left = self.within(lo, hi)
        out += [self.t.line(self.value(v)) for v in left if not (v.undefined or v.it or v.done)]
        out = self.terms_blocks(self.folded(out))
        k = self.index(hi)
        if k >= 2 and self.index(lo) <= k - 2 and self.blank_before(k):
            out.append(self.t.line())
        return out

    def block(self, lo: int, hi: int) -> int:
        return self.t.node("k", self.t.chain(self.statements(lo, hi)))

    def expression(self, lo: int, hi: int) -> int:
        found = self.statements(lo, hi)
        if len(found) != 1:
            raise Unsupported("an expression of several statements")
        return self.t.at(found[0]).head

    def terms_blocks(self, lines: list[int]) -> list[int]:
        """A mark of using terms from takes the statements after it."""
        for k in range(len(lines) - 1, -1, -1):
            w = self.t.at(self.t.at(lines[k]).head)
            if w.letter == "w" and w.kids[0] == 0:
                self.t.x.nodes[self.t.at(lines[k]).head] = Node("w", 0, (self.t.node("k", self.t.chain(lines[k + 1 :])), w.kids[1]))
                del lines[k + 1 :]
        return lines

    def _taken(self, line: int) -> tuple[str, object, int, int] | None:
        """(letter, number or property, whole, target) of a line: set target to item number, or property, of whole."""
        s = self.t.at(self.t.at(line).head)
        ref = self.t.at(s.kids[0]) if s.letter in ("r", "s") and len(s.kids) == 2 else None
        if ref is None or ref.letter != "n" or len(ref.kids) != 2:
            return None
        part = self.t.at(ref.kids[0])
        if part.letter == "4" and self.t.x.codes.get(part.head) == "cobj" and (n := self.t.x.ints.get(self.t.at(part.kids[1]).head)) is not None:
            return s.letter, n, ref.kids[1], s.kids[1]
        return (s.letter, part.head, ref.kids[1], s.kids[1]) if part.letter in ("1", "o") and s.letter == "r" and part.head < 0 else None

    def folded(self, lines: list[int]) -> list[int]:
        """set {a, b} to x, or set {p:a} to x, from the single sets that the compiler makes of it, inner lists first."""
        while True:
            out, k, changed = [], 0, False
            while k < len(lines):
                group, j = [], k
                while j < len(lines) and (t := self._taken(lines[j])) and (not group or t[0] == group[0][0] and t[2] == group[0][2]):
                    by_item = t[1] if isinstance(t[1], int) and t[1] > 0 else None
                    if by_item is not None and by_item != len(group) + 1 or group and (by_item is None) != (group[0][1] != 1):
                        break
                    group.append(t)
                    j += 1
                whole = group[0][2] if group else 0
                left = False
                if group and j < len(lines):
                    head = self.t.at(lines[j]).head
                    left = whole in (head, self.t.at(head).head if self.t.at(head).letter == "e" else head)
                by_items = bool(group) and group[0][1] == 1
                w = self.t.at(whole)
                inner = w.letter == "n" and self.t.at(w.head).letter == "4"
                if group and (left or by_items and inner and len(group) > 1):
                    target = self.t.node("J", self.t.chain(t[3] for t in group)) if by_items else self.t.node("K", self.t.cells((t[1], t[3]) for t in group))
                    out.append(self.t.line(self.t.node(group[0][0], whole, target)))
                    k, changed = j + left, True
                else:
                    out.append(lines[k])
                    k += 1
            lines = out
            if not changed:
                return lines

    def locals(self, v: Vector, run: bool) -> list[str]:
        """The variables that were declared local: those numbered out of the order of their first uses."""
        own = self.h.vars
        bound = len(v.items[3].pairs) if isinstance(v.items[3], Binding) else 0
        first = _count(self.h.params) + len(_pattern(v) or []) + bound
        by_name: dict[str, int] = {}
        for k, n in enumerate(own):
            by_name.setdefault(n.lower(), k)
        order: list[int] = []
        implied: set[int] = set()

        def use(k: int | None, by_itself: bool = False) -> None:
            if k is not None and first <= k < len(own) and k not in order:
                order.append(k)
                implied.update([k] * by_itself)

        for pc, i in enumerate(self.code):
            if i.name.startswith(("PushVariable", "PopVariable")):
                use(i.args[-1])
            elif i.name == "EndDefineActor" and pc + 1 < len(self.code) and self.code[pc + 1].name.startswith("PopVariable"):
                use(self.code[pc + 1].args[-1], True)
            elif i.name in ("RepeatInRange", "RepeatInCollection"):
                use(i.args[0], True)
            elif i.name == "HandleError":
                told, more = self.literal(i.args[0]), self.literal(i.args[1])
                for n in [told, *(w for _, w in more.pairs)] if isinstance(more, Binding) else [told]:
                    use(by_name.get(n.lower()) if isinstance(n, str) else None, True)
        outer = self.t.declared | self.t.earlier
        k = first - 1
        for n in range(first, len(own)):
            if n not in order or n not in implied and (run or own[n].lower() in outer):
                k = n
        while k < len(own) - 1 and [n for n in order if n > k] != list(range(k + 1, len(own))):
            k += 1
        return own[first : k + 1]

    # --- instructions: values ------------------------------------------------------------------------

    def op_PushLiteral(self, i, pc):
        v = self.literal(i.args[-1])
        if isinstance(v, Vector) and v.kind == 19:  # what a whose clause looks at
            self.push(self.t.node("g"), it=True)
        else:
            self.push(self.t.literal(v), count=v if isinstance(v, int) and not isinstance(v, bool) else -1)

    op_PushLiteralExtended = op_PushLiteral

    def op_PushGlobal(self, i, pc):
        self.push(self.t.literal(self.literal(i.args[-1])))

    op_PushGlobalExtended = op_PushGlobal

    def op_PushVariable(self, i, pc):
        self.push(self.t.node("o", self.local(i.args[-1])))

    op_PushVariableExtended = op_PushVariable

    def op_PushParentVariable(self, i, pc):
        self.push(self.parent(i))

    def parent(self, i) -> int:
        level, k = i.args
        names = self.t.scopes[-level] if 1 <= level <= len(self.t.scopes) else []
        return self.t.node("o", self.t.name(names[k] if 0 <= k < len(names) else f"parent{level}_{k}"))

    def number(self, n: int) -> None:
        self.push(self.t.literal(n), count=n)

    def op_PushMinus1(self, i, pc):
        self.number(-1)

    def op_Push0(self, i, pc):
        self.number(0)

    def op_Push1(self, i, pc):
        self.number(1)

    def op_Push2(self, i, pc):
        self.number(2)

    def op_Push3(self, i, pc):
        self.number(3)

    def op_PushTrue(self, i, pc):
        self.push(self.t.literal(True))

    def op_PushFalse(self, i, pc):
        self.push(self.t.literal(False))

    def op_PushEmpty(self, i, pc):
        self.push(self.t.node("J", self.t.none()))

    def op_PushMe(self, i, pc):
        self.push(self.t.node("f"))

    def op_PushIt(self, i, pc):
        self.push(self.t.node("g"), it=True)

    def op_PushUndefined(self, i, pc):
        self.push(0, undefined=True)

    def op_PushNext(self, i, pc):
        self.push(0, following=True)

    def op_GetResult(self, i, pc):
        self.push(self.t.node("o", self.t.name("result")), undefined=True)

    def op_GetData(self, i, pc):
        if self.stack:
            top = self.stack[-1]
            if top.got:
                top.ref = self.t.node("e", top.ref)
            top.got = True

    def op_Dup(self, i, pc):
        top = self.pop()
        top.got = False
        self.stack += [top, Item(**vars(top))]

    def op_GCSwap(self, i, pc):
        b, a = self.pop(), self.pop()
        self.stack += [b, a]

    def op_ObjectAliasQuote(self, i, pc):
        self.push(self.t.node("N", self.pop().ref))

    def op_Not(self, i, pc):
        self.push(self.t.node("H" if i.name == "Not" else "d", self.pop().ref))

    op_Negate = op_Not

    def op_And(self, i, pc):
        left, end = self.pop(), i.target
        right = self.expression(i.off + i.size, end)
        n = self.t.at(right)
        if n.letter == "c" and self.t.x.codes.get(self.t.at(n.kids[1]).head) == "bool":  # the compiler's own coercion
            right = n.kids[0]
        self.push(self.t.node("F" if i.name == "And" else "G", left.ref, right))
        return self.index(end)

    op_Or = op_And

    def op_MakeComp(self, i, pc):
        kind, right = i.args[0], self.pop()
        if kind == 11:
            self.push(self.t.node("H", right.ref))
        elif kind < 11:
            self.push(self.t.node("=>?@ABCDEFG"[kind], self.pop().ref, right.ref))
        else:
            raise Unsupported(f"comparison {kind}")

    def op_MakeVector(self, i, pc):
        items = [v.ref for v in self.arguments()]
        letter = "v" if i.name == "MakeList" else "J"
        held = [self.t.at(r) for r in items]
        if len(held) > 1 and all(n.letter == "n" and not n.flags and len(n.kids) == 2 and n.kids[1] == held[0].kids[1] for n in held):  # {a, b} of x
            self.push(self.t.node("n", self.t.node(letter, self.t.chain(n.kids[0] for n in held)), held[0].kids[1]))
        else:
            self.push(self.t.node(letter, self.t.chain(items)))

    op_MakeList = op_MakeVector

    def op_MakeRecord(self, i, pc):
        held = self.arguments()
        self.push(self.t.node("K", self.t.cells((self.label(k.ref), v.ref) for k, v in zip(held[::2], held[1::2]))))

    def op_MakeObjectAlias(self, i, pc):
        self.push(self.element(i.args[0]))

    def element(self, kind: int) -> int:
        """A reference: forms 0 to 11 are property, every, some, index, key, filter, range, before, after, beginning, end, middle."""
        t, x = self.t, self.t.x
        if kind == 5:
            test, whole = self.pop(), self.pop()
            return t.node("6", whole.ref, test.ref, flags=ALT if t.at(t.at(test.ref).head).letter == "g" else 0)
        form = self.pop() if kind == 4 else None
        last = self.pop() if kind == 6 else None
        which = self.pop() if kind in (3, 4, 6) else None
        what = self.pop() if kind not in (9, 10) else None
        owner = self.pop()
        if owner.got and t.at(owner.ref).letter in ("n", "1", "6"):
            owner.ref = t.node("e", owner.ref)
        code = x.codes.get(self.label(what.ref)) if what else None
        if kind == 0:
            part = what.ref
        elif kind == 1:
            part = t.node("2", self.label(what.ref), flags=ALT if code == "prop" else 0)
        elif kind in (2, 11):
            part = t.node("3" if kind == 2 else "<", self.label(what.ref))
        elif kind == 3:
            at = t.node("e", which.ref) if code == "capp" and t.at(which.ref).letter == "m" and t.at(owner.ref).letter == "g" else which.ref
            part = t.node("4", self.label(what.ref), at)
        elif kind == 4:
            part = t.node("5", self.label(what.ref), which.ref, t.term(x.codes.get(t.at(form.ref).head, "name")))
        elif kind == 6:
            ends = [n.kids[0] if (n := t.at(e.ref)).letter == "n" and n.kids[1:] == (owner.ref,) else e.ref for e in (which, last)]
            part = t.node("7", self.label(what.ref), *ends, flags=THE)
        else:
            part = t.node("89:;"[kind - 7], *([self.label(what.ref)] if what else []))
        letter = t.at(part).letter
        if owner.it:
            if kind == 0 and letter in ("o", "1"):
                return t.node("n", part, t.node("g"), flags=POSSESSIVE | (IMPLICIT if letter == "1" else 0))
            return part
        mine = t.at(owner.ref).letter == "f"
        if mine and kind in (3, 4) and code == "psxf":
            return part
        far = owner.ref
        while t.at(far).letter == "n":
            far = t.at(far).kid(1)
        to_app = kind in (0, 3) and x.codes.get(t.at(far).head) == "cura" and t.at(far).letter in ("m", "1")
        return t.node("n", part, owner.ref, flags=ALT if kind == 0 and mine and letter == "o" else POSSESSIVE if to_app else 0)

    def op_PositionalMessageSend(self, i, pc):
        self.push(self.positional(i))

    def positional(self, i) -> int:
        args = [self.value(v) for v in self.arguments()]
        target = self.pop()
        call = self.t.node("I", self.t.key(self.literal(i.args[0])), self.t.chain(args), self.t.none())
        if target.it:
            return call
        return self.t.node("n", call, target.ref, flags=ALT if self.t.at(target.ref).letter == "f" else POSSESSIVE)

    def op_MessageSend(self, i, pc):
        self.push(self.message(i))

    def message(self, i) -> int:
        args = self.arguments()
        direct = self.pop()
        pairs = [(self.label(k.ref), self.value(v)) for k, v in zip(args[::2], args[1::2])]
        pairs = [p for p in pairs if self.t.x.codes.get(p[0]) != "Krtn"]
        labels = self.t.cells(pairs) if pairs else self.t.none()
        return self.t.node("I", self.t.key(self.literal(i.args[0])), self.t.none() if direct.it else self.value(direct), labels)

    def op_Continue(self, i, pc):
        direct = None
        if len(self.stack) > 1 and self.stack[-2].following and not self.stack[-1].it and not self.stack[-1].following:
            direct = self.stack.pop()
        while self.stack and (self.stack[-1].it or self.stack[-1].following):
            self.stack.pop()
        call = self.message(i) if i.name == "Continue" else self.positional(i)
        n = self.t.at(call)
        if n.letter == "n":
            call = n.head
        elif direct or self.t.at(n.kids[1]).letter == "f":
            self.t.x.nodes[call] = Node("I", n.flags, (n.kids[0], direct.ref if direct else self.t.none(), *n.kids[2:]))
        self.push(self.t.node("M", call))

    op_PositionalContinue = op_Continue

    # --- instructions: statements --------------------------------------------------------------------

    def store(self, target: int) -> None:
        """Statement that stores the top of the stack, which stays."""
        v = self.pop()
        n = self.t.at(v.ref)
        if v.script:
            self.emit(v.ref)
        elif n.letter == "s" and len(n.kids) == 1:
            self.emit(self.t.node("s", n.head, target))
            for other in self.stack:
                other.done |= other.ref == v.ref
        else:
            self.emit(self.t.node("r", v.ref, target))
        self.push(v.ref, done=True)

    def op_PopGlobal(self, i, pc):
        self.store(self.t.literal(self.literal(i.args[-1])))

    op_PopGlobalExtended = op_PopGlobal

    def op_PopVariable(self, i, pc):
        self.store(self.t.node("o", self.local(i.args[-1])))

    op_PopVariableExtended = op_PopVariable

    def op_PopParentVariable(self, i, pc):
        self.store(self.parent(i))

    def op_MatchLiteral(self, i, pc):
        self.store(self.t.literal(self.literal(i.args[0])))

    def op_Clone(self, i, pc):
        self.push(self.t.node("s", self.pop().ref))

    def op_SetData(self, i, pc):
        target, v = self.pop(), self.pop()
        self.emit(self.t.node("r" if i.name == "SetData" else "s", v.ref, target.ref))
        self.push(v.ref, done=True)

    op_CopyData = op_SetData

    def op_StoreResult(self, i, pc):
        if self.stack:
            v = self.stack.pop()
            if not v.undefined and not v.done:
                self.emit(self.value(v))

    def op_Pop(self, i, pc):
        if self.stack:
            v, before = self.stack.pop(), self.code[pc - 1] if pc else None
            if before and before.name.startswith("PushLiteral") and isinstance(self.literal(before.args[-1]), App):
                self.emit(self.t.node("w", 0, v.ref))

    def op_Return(self, i, pc):
        if i.off + i.size == len(self.h.code):  # every handler's last: what is pending is a statement
            for v in self.stack:
                if not (v.undefined or v.done or v.it or v.following):
                    self.emit(self.value(v))
            self.stack.clear()
        else:
            self.emit(self.t.node("L", self.stack.pop().ref) if self.stack else self.t.node("L"))

    def op_Exit(self, i, pc):
        self.emit(self.t.node("S"))

    def op_Error(self, i, pc):
        text, args = self.pop(), self.arguments()
        if self.stack:
            self.stack.pop()
        pairs = [(self.label(k.ref), v.ref) for k, v in zip(args[::2], args[1::2])]
        self.emit(self.t.node("R", self.t.none(), self.t.none() if text.undefined else text.ref, self.t.cells(pairs) if pairs else self.t.none()))

    def op_TestIf(self, i, pc):
        t, test, other = self.t, self.pop(), i.target
        then_end = end = other
        k = self.at.get(other, 0)
        if k:
            jump = self.code[k - 1]
            if jump.name == "Jump" and jump.off > i.off and jump.target > other:
                then_end, end = jump.off, jump.target
        then = self.block(i.off + i.size, then_end)
        more, last = t.none(), t.none()
        if end > other:
            found = self.statements(other, end)
            n = t.at(t.at(found[0]).head) if len(found) == 1 else Node("", 0, ())
            if n.letter == "Z":  # alone in an else: else if
                inner, more = t.new(), t.new()
                t.x.cells[inner] = (n.kids[1], n.kids[2] if n.kids[2] > 0 else t.none())
                t.x.cells[more] = (n.kids[0], inner)
                last = n.kids[3]
            elif found:
                last = t.node("k", t.chain(found))
        self.emit(t.node("Z", test.ref, then, more, last))
        return self.index(end)

    def op_Tell(self, i, pc):
        t, target = self.t, self.pop()
        k = self.end_of(pc, "Tell", "EndTell")
        lines, left = self.within(i.off + i.size, self.code[k].off)
        after = self.code[k + 1].name if k + 1 < len(self.code) else "Return"
        left = [v for v in left if not (v.undefined or v.done or v.it)]
        if left and not lines and after not in ENDS:
            value = left[-1].ref
            lone = t.at(target.ref).letter == "m" and t.x.codes.get(t.at(target.ref).head) == "cura"
            self.push(value if lone else t.node("O", value, target.ref, flags=ALT))
            return k + 1
        lines = self.terms_blocks(self.folded(lines + [t.line(self.value(v)) for v in left[-1:]]))
        if k - 2 > pc and self.blank_before(k):
            lines.append(t.line())
        self.emit(t.node("O", t.node("k", t.chain(lines)), target.ref))
        return k + 1

    def op_BeginTimeout(self, i, pc):
        v = self.pop()
        k = self.end_of(pc, i.name, "End" + i.name[5:])
        held = self.block(i.off + i.size, self.code[k].off)
        self.emit(self.t.node("t" if i.name == "BeginTimeout" else "u", held, self.t.none() if v.undefined else v.ref))
        return k + 1

    op_BeginTransaction = op_BeginTimeout

    def op_Consider(self, i, pc):
        ignored, minded = self.pop(), self.pop()
        k = self.end_of(pc, "Consider", "EndConsider")

        def named(ref: int) -> int:
            n = self.t.at(ref)
            found = [self.label(c[0]) for c in self.t.x.chain(n.head)] if n.letter == "J" else []
            return self.t.chain(found) if found else self.t.none()

        self.emit(self.t.node("P", self.block(i.off + i.size, self.code[k].off), named(minded.ref), named(ignored.ref)))
        return k + 1

    def op_ErrorHandler(self, i, pc):
        t, k = self.t, self.index(i.target)
        if not 0 < k < len(self.code) or self.code[k - 1].name != "EndErrorHandler":
            raise Unsupported("a try without its end")
        close, first = self.code[k - 1], self.code[k]
        held, start = self.block(i.off + i.size, close.off), i.target
        text, labels = t.none(), t.none()
        if first.name == "HandleError":
            start += first.size
            told, more = self.literal(first.args[0]), self.literal(first.args[1])
            text = t.none() if told is None else t.variable(told)
            if isinstance(more, Binding) and more.pairs:
                labels = t.cells((t.key(a), t.variable(b)) for a, b in more.pairs)
        caught = self.statements(start, close.target) if close.target > start else []
        self.emit(t.node("Q", held, t.node("R", t.none(), text, labels), t.node("k", t.chain(caught)) if caught else t.none()))
        return self.index(close.target)

    def op_LinkRepeat(self, i, pc):
        t, end = self.t, self.index(i.target)
        back = next((k for k in range(end - 1, pc, -1) if self.code[k].name == "Jump" and self.code[k].target < self.code[k].off), None)
        if back is None:
            raise Unsupported("a loop that doesn't turn back")
        top = self.index(self.code[back].target)
        marks = back >= 2 and (self.code[back - 2].name, self.code[back - 1].name) == ("Dup", "StoreResult")
        first, last = self.code[top], self.code[back - 2 if marks else back].off
        if first.name == "Pop":
            self.emit(t.node("T", self.block(self.code[top + 1].off, last)))
        elif first.name in ("RepeatNTimes", "RepeatInRange", "RepeatInCollection"):
            _, given = self.within(i.off + i.size, first.off)
            if len(given) < (3 if first.name == "RepeatInRange" else 1):
                raise Unsupported("a loop without its bounds")
            held = self.block(first.off + first.size, last)
            if first.name == "RepeatNTimes":
                self.emit(t.node("U", held, given[0].ref))
            elif first.name == "RepeatInRange":
                by = [] if given[2].count == 1 else [given[2].ref]
                self.emit(t.node("Y", held, self.local(first.args[0]), given[0].ref, given[1].ref, *by))
            else:
                got = top >= 8 and (self.code[top - 8].name, self.code[top - 7].name) == ("GetData", "Dup") and t.at(given[0].ref).letter in tuple(REFERENCES)
                self.emit(t.node("X", held, self.local(first.args[0]), t.node("e", given[0].ref) if got else given[0].ref))
        else:
            test = next((k for k in range(top, back) if self.code[k].name in ("RepeatWhile", "RepeatUntil")), None)
            if test is None:
                raise Unsupported("a loop of unknown form")
            at = self.code[test]
            asked = self.expression(first.off, at.off)
            self.emit(t.node("V" if at.name == "RepeatWhile" else "W", self.block(at.off + at.size, last), asked))
        return end

    def op_DefineActor(self, i, pc):
        t = self.t
        self.pop()
        named, v = self.pop(), self.literal(i.args[0])
        t.scopes.append(self.h.vars)
        try:
            if isinstance(v, Vector) and v.kind == 15 and len(v.items) >= 4:
                inside = t.script(v.items[3], False)
            elif h := Handler.of(v):  # code that makes the object
                inside = [n for n in t.code(h, v, "init") if t.at(t.at(n).head).letter != "q"]
                inside = [t.line(t.node("j", t.at(s.kids[1]).head, s.kids[0])) if (s := t.at(t.at(n).head)).letter == "r" else n for n in inside]
            else:
                raise Unsupported("a script object's literal")
        finally:
            t.scopes.pop()
        n = t.at(named.ref)
        nameless = named.undefined or n.letter == "m" and t.x.codes.get(n.head) == "msng"
        self.push(t.node("h", t.none() if nameless else self.label(named.ref), t.node("k", t.chain(inside))), script=True)

    def op_EndDefineActor(self, i, pc):
        pass

    def op_DefineProperty(self, i, pc):
        v, name = self.pop(), self.literal(i.args[0])
        self.emit(self.t.node("j", self.t.key(name) if name is not None else self.t.term("pare"), v.ref))
        self.push(v.ref, done=True)

    def op_DefineProcedure(self, i, pc):
        v = self.literal(i.args[0])
        h = Handler.of(v)
        if not h:
            raise Unsupported("a handler's literal")
        self.t.scopes.append(self.h.vars)
        try:
            self.out += [self.t.handler(h, v), self.t.line()]
        finally:
            self.t.scopes.pop()


def _binary(letter: str):
    def op(self: Run, i: Instruction, pc: int) -> None:
        right, left = self.pop(), self.pop()
        self.push(self.t.node(letter, self.value(left), self.value(right)))  # operators evaluate: what was evaluated before was a get

    return op


for _name, _letter in BINARY.items():
    setattr(Run, f"op_{_name}", _binary(_letter))


def from_bytecode(b: bytes, dictionaries: dict[str, Dictionary] | None = None, encoding: str | None = None) -> str:
    """The source of a compiled script, from its bytecode alone. encoding: of old strings, instead of the one they show."""
    rows = records(body(b)[1])
    with reading(rows, encoding):
        values = Values(rows)
        root = values.value(0)
        if not isinstance(root, Vector) or not root.items:
            raise Unsupported("no script object")
        t = Tree(values)
        table = [None, [], root] if root.kind in (16, 17) else root.items[-1]
        top = t.script(table, True)
        t.x.wraps[0] = (15, (-1, t.node("k", t.chain(top))))
        return Printer(t.x, dictionaries, rebuilt=True).whole()
