"""Syntax trees built node by node, and the source that they print."""

import struct

import pytest

from palimpsest.functions import records, source
from tests import builders as B


class Tree:
    """Builds a script's records; nodes, names and terms get references of their own."""

    def __init__(self):
        self.out, self.next, self.low = b"", 100, -1

    def inline(self) -> int:
        self.low -= 1
        return self.low

    def shared(self) -> int:
        self.next += 1
        return self.next

    def node(self, letter: str, *kids: int, flags: int = 0) -> int:
        ref = self.shared()
        self.out += struct.pack(">BhHBHHH", 0x0D, ref, len(kids), ord(letter), flags, 0, 0) + struct.pack(f">{len(kids)}h", *kids)
        return ref

    def name(self, *spelt: str) -> int:
        ref = self.inline()
        self.out += B.word(ref, *spelt)
        return ref

    def code(self, code: str) -> int:
        ref = self.inline()
        self.out += B.raw(0x0A, ref, code.encode(), 0x0A)
        return ref

    def event(self, code: str) -> int:
        ref = self.inline()
        self.out += B.raw(0x0A, ref, code.encode() + b"null" + bytes(12), 0x2E)
        return ref

    def var(self, name: str) -> int:
        return self.node("o", self.name(name))

    def number(self, n: int) -> int:
        ref = self.inline()
        self.out += B.number(ref, n)
        return self.node("m", ref)

    def text(self, s: str) -> int:
        a, b = self.shared(), self.shared()
        self.out += B.refs(0x0E, a, [b], 0xB1) + B.raw(0x11, b, s.encode("utf-16-be"))
        return self.node("m", a)

    def constant(self, code: str) -> int:
        return self.node("m", self.code(code))

    def list(self, *items: int) -> int:
        tail = self.inline()
        for item in reversed(items):
            ref = self.shared()
            self.out += B.refs(0x02, ref, [item, tail])
            tail = ref
        return tail

    def labelled(self, *pairs) -> int:
        tail = self.inline()
        for key, value in reversed(pairs):
            ref = self.shared()
            self.out += B.refs(0x06, ref, [key, value, tail])
            tail = ref
        return tail

    def call(self, head: int, direct: int | None = None, labels: int | None = None, flags: int = 0) -> int:
        return self.node("I", head, direct or self.inline(), labels or self.inline(), flags=flags)

    def block(self, *statements: int) -> int:
        return self.node("k", self.list(*(self.node("l", s, flags=2) for s in statements)))

    def script(self, *statements: int) -> str:
        top = self.block(*statements)
        whole = b"FasdUAS 1.101.10" + B.refs(0x0E, 0, [-1, top], 15) + self.out + b"ascr\0\1\0\x0c\xfa\xde\xde\xad"
        return source.decompile(whole)


def test_handlers_and_flow():
    t = Tree()
    x, n = t.var("x"), t.number
    loop = t.node("Y", t.block(t.node("r", t.node("[", t.var("total"), t.var("i")), t.var("total"))), t.name("i"), n(1), n(10), t.inline())
    test = t.node("Z", t.node("B", x, n(1)), t.node("L", n(1)), t.inline(), t.inline(), flags=1)
    minus = t.node("]", x, t.node("l", t.call(t.name("fact"), t.list(t.node("\\", x, n(1)))), flags=4))
    fact = t.node("i", t.call(t.name("fact"), t.list(x)), t.block(test, loop, t.node("L", minus)))
    span = t.node("i", t.call(t.name("span"), None, t.labelled((t.code("from"), t.var("a")), (t.code("to  "), t.var("b")))), t.block(t.node("S")))
    area = t.node("L", t.call(t.name("area"), None, t.labelled((t.name("width"), n(2)), (t.name("deep"), t.constant("true")))))
    run = t.node("i", t.call(t.event("aevtoapp"), t.var("argv")), t.block(area))
    assert t.script(fact, span, run) == (
        "on fact(x)\n\tif x ≤ 1 then return 1\n\trepeat with i from 1 to 10\n\t\tset total to total + i\n\tend repeat\n\treturn x * (fact(x - 1))\nend fact\n"
        "on span from a to b\n\texit repeat\nend span\non run argv\n\treturn area with deep given width:2\nend run\n"
    )


def test_references_and_commands():
    t = Tree()
    finder = t.node("4", t.code("capp"), t.text("Finder"))
    where = t.node("6", t.node("2", t.code("file")), t.node("=", t.node("1", t.code("pnam")), t.text('a "b"'), flags=3))
    dialog = t.call(t.event("sysodlog"), t.node("b", t.text("n: "), t.node("n", t.node("1", t.code("leng")), t.var("s"))), t.labelled((t.code("btns"), t.node("J", t.list(t.text("OK")))), (t.code("givu"), t.number(3)), (t.code("htxt"), t.constant("true"))))
    tell = t.node("O", t.block(t.node("r", where, t.var("found")), dialog), finder)
    item = t.node("n", t.node("4", t.code("cobj"), t.number(1), flags=1), t.call(t.event("misccurd")))
    own = t.node("n", t.call(t.name("f"), t.list(t.number(2))), t.node("f"), flags=1)
    words = t.node("n", t.node("7", t.code("cwor"), t.number(1), t.number(-1), flags=0x100), t.var("list"))
    negated = t.node("H", t.node("E", t.var("s"), t.text("x")))
    attempt = t.node("Q", t.block(t.node("s", item, t.var("y"))), t.node("R", t.inline(), t.var("msg"), t.labelled((t.code("errn"), t.var("n")))), t.block(t.node("r", t.node("c", own, t.node("1", t.code("TEXT"))), t.node("J", t.list(t.var("p"), t.var("q"))))))
    assert t.script(tell, attempt, t.node("r", negated, t.var("ok")), t.node("r", words, t.var("w"))) == (
        'tell application "Finder"\n\tset found to every file whose name is "a \\"b\\""\n\tdisplay dialog "n: " & length of s buttons {"OK"} giving up after 3 with hidden answer\nend tell\n'
        "try\n\tcopy first item of (current date) to y\non error msg number n\n\tset {p, q} to my f(2) as string\nend try\nset ok to s does not contain \"x\"\nset w to words 1 thru -1 of list\n"
    )


def test_comments_breaks_and_names():
    t = Tree()
    note = t.shared()
    t.out += B.raw(0x0C, note, struct.pack(">H", 5) + b" note" + bytes(2))
    commented = t.node("l", t.node("S"), note, flags=1)
    broken = t.node("r", t.node("[", t.var("a"), t.node("l", t.var("b"), flags=8)), t.node("o", t.name("end")))
    spread = t.node("n", t.call(t.name("setValue_forKey_"), t.list(t.number(1), t.text("k"))), t.var("d"), flags=2)
    top = t.node("k", t.list(commented, t.node("l", flags=2), t.node("l", broken, flags=2), t.node("l", spread, flags=2)))
    whole = b"FasdUAS 1.101.10" + B.refs(0x0E, 0, [-1, top], 15) + t.out + b"ascr\0\1\0\x0c\xfa\xde\xde\xad"
    assert source.decompile(whole) == 'exit repeat -- note\n\nset |end| to a + ¬\n\tb\nd\'s setValue:1 forKey:"k"\n'


def test_trees_that_turn_back_end():
    t = Tree()
    ref = t.next + 1
    t.node("[", ref, ref)
    assert "«…»" in t.script(t.node("L", ref))
    deep = t.number(1)
    for _ in range(400):
        deep = t.node("d", deep)
    assert "«…»" in t.script(t.node("L", deep))


def test_literals_and_fallbacks():
    assert source.described("ldt ", (3_000_000_000).to_bytes(8, "big")) == 'date "Sunday, January 24, 1999 at 5:20:00\u202fAM"'
    assert source.described("xyz ", b"\1\xab") == "«data xyz 01AB»" and source.rounded(3.14159265358979) == "3.14159265359" and source.rounded(2.0) == "2.0"
    assert [source.plural(x) for x in ("text item", "box", "folder entry", "day", "rich text")] == ["text items", "boxes", "folder entries", "days", "rich text"]
    assert [source.ordinal(n) for n in (1, 2, 3, 4, 11, 112, 121)] == ["1st", "2nd", "3rd", "4th", "11th", "112th", "121st"]
    assert source.decompile("say é".encode()) == "say é"
    with pytest.raises(records.Damaged, match="dialect"):
        source.decompile(B.compiled().replace(b"1.101.10", b"0.95", 1))


def test_damaged_scripts_give_what_can_be_told():
    t = Tree()
    top = t.block(t.node("r", t.text("kept"), t.var("x")), t.node("S"))
    first = B.refs(0x0E, 0, [-1, top], 15)
    for junk in (b"\x99\x98", b"\x05\x00\x01"):
        whole = b"FasdUAS 1.101.10" + first + t.out[:40] + t.out[40:] + junk + b"ascr\0\1\0\x0c\xfa\xde\xde\xad"
        with pytest.raises(records.Damaged):
            records.records(records.body(whole)[1])
        assert source.decompile(whole) == 'set x to "kept"\nexit repeat\n'
    rows = records.tolerant(b"\x99" + first + b"\xff\xff" + t.out)
    assert [r.typ for r in rows].count(0x0D) == t.out.count(b"\x0d\x00") and rows[0].ref == 0


def test_applications_by_alias():
    def alias(name: str) -> bytes:
        a = bytearray(150)
        a[50 : 51 + len(name)] = bytes([len(name)]) + name.encode()
        return bytes(10) + b"alis" + bytes(a) + struct.pack(">hH", 14, 2 + 2 * len(name)) + struct.pack(">H", len(name)) + name.encode("utf-16-be") + b"\xff\xff\0\0"

    t = Tree()
    a, b = t.shared(), t.shared()
    t.out += B.raw(0x0F, a, alias("Finder.app"), 8) + B.raw(0x0F, b, alias("Odd Tool.app"), 8)
    assert t.script(t.node("r", t.node("m", a), t.var("x")), t.node("r", t.node("m", b), t.var("y"))) == 'set x to application "Finder"\nset y to application "Odd Tool.app"\n'
