import struct

import pytest

from palimpsest.functions import projects as P

STATE = bytes([0, 4, 0, 9, 0, 2] + [0] * 8) + struct.pack(">4h", 40, 20, 322, 492)


def script(s: str) -> bytes:
    return s.replace("\n", "\r").encode("mac_roman") + b"\0" + STATE


def rec(b: bytes) -> bytes:
    return struct.pack(">I", len(b)) + b + bytes(len(b) % 2)


def field(s: str, runs: int = 0) -> bytes:
    return struct.pack(">H", runs) + bytes(20 * runs) + s.replace("\n", "\r").encode("mac_roman") + bytes(14)


class Make:
    def __init__(self, major: int, minor: int):
        self.major, self.minor, self.blocks, self.handle = major, minor, {}, 0x120000
        self.form = P.FORMS[2 if major == 2 else min(minor, 1)]

    def head(self, kind: int, at: int) -> bytes:
        return struct.pack(">H", kind).ljust(at - 12, b"\0")

    def listed(self, size: int, rows: list[list[tuple[int, bytes | None]]], starts: list[bytes]) -> bytes:
        fixed = held = b""
        for handles, start in zip(rows, starts):
            r = bytearray(start.ljust(size, b"\0"))
            for at, b in handles:
                if b is not None:
                    self.handle += 4
                    struct.pack_into(">I", r, at, self.handle)
                    held += rec(b)
            fixed += bytes(r)
        return fixed + held + struct.pack(">H", len(rows))

    def objects(self, rows: list[tuple]) -> bytes:
        """Rows of type, id, data, name, script, properties."""
        handles = [[(62, d), (58, n.encode() if n else None), (66, script(s) if s else None), (86, q)] for _, _, d, n, s, q in rows]
        return self.listed(self.form.obj, handles, [struct.pack(">H4xI", t, i) for t, i, *_ in rows])

    def layer(self, ident: int, kind: int, name: str, source: str, rows: list[tuple], texts: list[tuple[int, str]] = ()) -> None:
        shared = b"".join(struct.pack(">II", i, len(field(t))) + field(t) for i, t in texts)
        self.blocks[ident] = self.head(kind, self.form.script[kind]) + rec(script(source)) + rec(self.objects(rows)) + (rec(shared) if kind == P.CARD else b"") + rec(name.encode())

    def bytes(self) -> bytes:
        out = bytearray(0x600)
        struct.pack_into(">HH", out, 0, self.major, self.minor)
        struct.pack_into(">I", out, 16, 128)
        for ident, b in sorted(self.blocks.items()):
            struct.pack_into(">I", out, 0x400 + 4 * ident, len(out))
            out += struct.pack(">III", ident, len(b), 0) + b
            out += bytes(-len(out) % 64)
        struct.pack_into(">I", out, 4, len(out))
        return bytes(out)


def sample(major: int, minor: int) -> Make:
    m = Make(major, minor)
    m.blocks[0] = m.head(P.PROJECT, m.form.script[P.PROJECT]) + rec(script("on start\nbeep\nend start"))
    m.blocks[5] = m.head(P.WINDOW, m.form.script[P.WINDOW] - 8) + struct.pack(">HHI", 1, 2, 6) + rec(script("")) + rec(b"Front")
    m.blocks[6] = m.head(P.CARD_LIST, 14) + b"".join(struct.pack(">4I", *e).ljust(64, b"\0") for e in ((8, 7, 101, 100), (9, 7, 102, 100)))
    m.layer(7, P.BACKGROUND, "", "", [(200, 1, None, "Go", "on mouseUp\nend mouseUp", None), (300, 70000, field("Old"), "Title", "", None), (301, 11, field("Hi", 1), "Body", "", None)])
    group = m.objects([(200, 5, None, "", "on mouseUp\nanswer 1\nend mouseUp", None)])
    m.layer(8, P.CARD, "Start", "on open\nend open", [
        (300, 2, field("One\nTwo", 1), "Notes", "", b"\0\1props" if major == 2 else None), (105, 3, b"\1\2\3", "", "", None), (108, 4, group, "Group", "", None), (201, 6, None, "Same", "on a\nend a", None), (201, 9, None, "Same", "", None),
    ], [(11, "Hi"), (70000, "New")])
    m.layer(9, P.CARD, "", "", [], [(99, "Gone"), (70000, "Second")])
    items = m.listed(m.form.item, [[(18, b"Open"), (22, script("on pick\nend pick"))], [(18, b"-"), (22, None)]], [b"", b""])
    m.blocks[10] = m.head(P.MENU, m.form.script[P.MENU]) + rec(script("")) + rec(items) + rec(b"File")
    m.layer(12, P.CARD, "", "on lost\nend lost", [])
    return m


SCRIPTS = """-- project
on start
  beep
end start

-- background button "Go" of background id 100 of window "Front"
on mouseUp
end mouseUp

-- card "Start" of window "Front"
on open
end open

-- card button id 5 of card "Start" of window "Front"
on mouseUp
  answer 1
end mouseUp

-- card button "Same" (id 6) of card "Start" of window "Front"
on a
end a

-- card 1 that no window lists
on lost
end lost

-- menuItem "Open" of menu "File"
on pick
end pick
"""
TEXTS = [('field "Title" of background id 100 of', "Old"), ('field "Title" of card "Start" of', "New"), ('field "Body" of card "Start" of', "Hi"), ('field "Notes" of card "Start" of', "One\nTwo"), ('field "Title" of card id 102 of', "Second")]


@pytest.mark.parametrize("version", [(1, 0), (1, 1), (2, 1)])
def test_project(version):
    data = sample(*version).bytes()
    p = P.parse(data)
    assert P.scripts_listing(p) == SCRIPTS
    assert P.text_listing(p) == "\n".join(f'-- {"card" if "Notes" in a else "background"} {a} window "Front"\n{t}\n' for a, t in TEXTS)
    standalone = data[:0x400] + b"Joy!peffpwpc" + bytes(500) + data[0x400:]
    assert P.scripts_listing(P.parse(standalone)) == SCRIPTS
    for bad in (b"", data[:-64], data + b"x", b"\0\3" + data[2:]):
        with pytest.raises(P.NotAProject):
            P.parse(bad)
    for k in range(0x600, len(data), 37):
        try:
            P.text_listing(P.parse(data[:k] + b"\xff\xfe" + data[k + 2 :]))
        except P.NotAProject:  # the damage met the first block's head
            pass


def test_protected_and_tokenized():
    plain, turn = script("on a\nbeep\nend a\n"), lambda b: bytes(c ^ 0xFD for c in b)
    zero = plain.index(0)
    r = P.Reader(sample(1, 0).bytes(), P.ROMAN)
    for held in (turn(plain), turn(plain[: zero - 1]) + plain[zero - 1 :]):
        assert P.is_script(P.PROTECTED + held) and r.source(P.PROTECTED + held) == "on a\nbeep\nend a\n"
    assert r.source(P.TOKENS + b"\0\1") == P.TOKENIZED


def test_match_prefers_the_most_for_the_first():
    name, source = b"n", script("x")
    assert P.match([P.Slots(False, True, False, 1), P.Slots(False, True, False, 1)], [name, name, name]) == [1, 0]
    assert P.match([P.Slots(False, True, True, 2)], [name, source, name]) == [1] and P.match([P.Slots(False, True, False, 0)], [source]) is None


def test_scripts_without_an_owner_are_listed():
    m = sample(1, 0)
    m.layer(9, P.CARD, "", "", [(200, 1, None, "", "on mouseUp\nend mouseUp", None)])
    at = m.form.script[P.CARD] - 12
    at = P.record(m.blocks[9], at)[1] + 4 + 66
    m.blocks[9] = m.blocks[9][:at] + bytes(4) + m.blocks[9][at + 4 :]
    assert "-- script of an object of card id 102" in P.scripts_listing(P.parse(m.bytes()))
