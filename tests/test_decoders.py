import os
import struct

import pytest

from palimpsest.functions import forks, images, records, stacks
from palimpsest.operators import decode
from palimpsest.sources import folders
from tests import builders as B

FORK = B.resource_fork([(b"STR ", 1, "", b"\0"), (b"scpt", 130, "other", b"no"), (b"scpt", 128, "main", B.compiled()), (b"XCMD", 5, "doIt", b"x")])


@pytest.mark.parametrize("wrapped", [B.mac_binary("F", b"osasToyS", b"data" * 40, FORK), B.bin_hex("F", b"osasToyS", b"data" * 40, FORK), B.apple_double(FORK, data=b"data" * 40)])
def test_wrappers(wrapped):
    f = forks.unwrap(wrapped)
    assert (f.type, f.creator, f.data, f.rsrc[: len(FORK)]) in (("osas", "ToyS", b"data" * 40, FORK), ("osas", "", b"data" * 40, FORK))
    assert [(t, i, n) for t, i, n, _ in forks.resources(f.rsrc)] == [("STR ", 1, ""), ("scpt", 130, "other"), ("scpt", 128, "main"), ("XCMD", 5, "doIt")]
    assert forks.script_resource(f.rsrc) == B.compiled() and records.body(wrapped)[0] == "1.10"


def test_damaged_input_gives_errors_not_crashes():
    for whole in (B.compiled(), B.stack(), FORK, B.disk(True, [("a", b"x" * 600, b"")])):
        for cut in range(0, len(whole), max(1, len(whole) // 40)):
            for b in (whole[:cut], whole[:cut] + b"\xff" * 8 + whole[cut + 8 :]):
                forks.resources(b), forks.unwrap(b), forks.kind(b)
                for f in (lambda b: records.Graph(records.records(records.body(b)[1])).handlers(), stacks.parse, lambda b: images.volumes(images.Part.of(b))):
                    try:
                        f(b)
                    except (ValueError, IndexError, struct.error):
                        pass


def test_types_that_share_a_list_are_read_once():
    fork = bytearray(B.resource_fork([(b"XCMD", 1, "", b"abc")] + [(bytes([65 + k]) * 4, 1, "", b"z") for k in range(20)]))
    base = struct.unpack_from(">I", fork, 4)[0] + 28
    for k in range(21):
        struct.pack_into(">H", fork, base + 2 + 8 * k + 6, 2 + 8 * 21)
    assert len(forks.resources(bytes(fork))) == 1


def test_script():
    version, body = records.body(b"#!/usr/bin/osascript\n" + B.compiled() + b"junk")
    rows = records.records(body)
    g = records.Graph(rows)
    (h,) = g.handlers()
    assert (h.name, h.params, h.vars, h.literals) == ("Add", ["x"], ["x"], [-2, 'a "b"', 12345.678]) and g.run_only()
    assert records.disassembly([h]).splitlines() == ["handler Add(x)  vars=[x]", "  00000  PushVariable          0  ; x", "  00001  PushLiteral           0  ; -2", "  00002  Add                   ", "  00003  Return                ", ""]
    found, wrong = records.instructions(bytes([0x59, 0, 2, 0x48]))
    assert found[0].target == 3 and wrong == "unknown opcode 0x48 at 3"
    assert [records.real(x) for x in (0.5, 100.0, 10000.0, 1e-5, 1.5e22, -2.25)] == ["0.5", "100.0", "1.0E+4", "1.0E-5", "1.5E+22", "-2.25"]
    assert len(records.OPERATIONS) == 256 - 2 - 3 - 41
    with pytest.raises(records.Damaged):
        records.records(body + b"\x05")
    with pytest.raises(records.Damaged, match="plain"):
        records.body(b"display dialog")


def test_lists_end_even_if_they_turn_back():
    rows = records.records(B.refs(2, 1, [2, 1]) + B.number(2, 7))
    assert len(records.Graph(rows).value(1)) == records.MAX_CHAIN


SCRIPTS = """-- external commands: doIt

-- stack
on openStack
  put 1
end openStack

-- background button "Go" of background "Back"
on mouseUp
  if x then
    beep
  else
    go next
  end if
end mouseUp

-- card id 12
on idle
end idle
"""
TEXTS = '-- card field id 3 of card id 12\nown\n\n-- background field "Notes" of card "Home"\ncafé ⌘\n'


def test_stack():
    for damage in (b"", b"\xff" * 96):
        s = stacks.parse(B.stack(damage), FORK)
        assert stacks.scripts_listing(s) == SCRIPTS and [c.ident for c in s.cards] == [12, 11] and s.told_cards == 2
    s = stacks.parse(B.stack(), FORK)
    assert stacks.scripts_listing(s) == SCRIPTS and stacks.text_listing(s) == TEXTS
    with pytest.raises(stacks.NotAStack):
        stacks.parse(b"FasdUAS 1.101.10" + bytes(20))


@pytest.mark.parametrize(("given", "want"), [
    ("on a\nif x\nthen y\nelse z\nend a", "on a\n  if x\n  then y\n  else z\nend a"),
    ("on a\nput 1 ¬\n+ 2\nrepeat\nend repeat\n\n-- if\nend a", "on a\n  put 1 ¬\n  + 2\n  repeat\n  end repeat\n\n  -- if\nend a"),
    ('on a\nput "--" & "x" -- if x then\nend b\nend a', 'on a\n  put "--" & "x" -- if x then\n  end b\nend a'),
    ("function f\nif a then\nb\nelse if c then\nd\nelse e\nend f", "function f\n  if a then\n    b\n  else if c then\n    d\n  else e\nend f"),
])
def test_indent(given, want):
    assert stacks.indent(given) == want


FILES = [("One", b"a" * 5000, b"r" * 2600), ("Two", b"", FORK), ("Three", b"plain", b"")]


def held(image: bytes, rsrc: bytes = b"") -> list:
    (v,) = images.volumes(images.Part.of(image), rsrc)
    assert v.name == "Disk"
    return sorted((f.path, f.type, v.read_data(f), v.read_rsrc(f)) for f in v.files)


@pytest.mark.parametrize("plus", [False, True])
def test_volumes_in_all_wrappers(plus):
    image = B.disk(plus, FILES)
    want = sorted((["Sub"] * (k % 2) + [n], "TEXT", d, r) for k, (n, d, r) in enumerate(FILES))
    assert held(image) == want and held(B.apm(image)) == want and held(B.gpt(image)) == want and held(B.udif(image)) == want
    assert held(*B.ndif(image)) == want
    assert held(B.mac_binary("img", b"rohddCpy", image, b"")) == want
    copy = bytearray(84) + image
    struct.pack_into(">I", copy, 64, len(image))
    copy[82] = 1
    assert held(bytes(copy)) == want
    with pytest.raises(images.NotAnImage):
        images.volumes(images.Part.of(b"x" * 4000))


def test_adc():
    assert images.adc(bytes([0x82]) + b"abc" + bytes([0x08, 2]) + bytes([0x40, 0, 0]), 100) == b"abc" + b"abcab" + b"b" * 4


def test_folders_and_tables(spark, tmp_path):
    root = tmp_path / "old"
    for name, data in {
        "a.scpt": B.compiled(), "_u": b"kept", "sub/Two": b"", "sub/._Two": B.apple_double(FORK), "notes.txt": b"set x to 1", "._gone": b"x", ".hidden/three": b"x", "sub/deep/s": B.stack(),
        "__MACOSX/sub/x": b"x", "z.hqx": B.bin_hex("Z", b"osasToyS", b"", FORK), "bad.scpt": B.compiled()[:60], "disk": B.disk(True, [("inner", B.disk(False, [("core", B.stack(), b"")]), b""), ("flat", B.compiled(), b"")]),
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    table = folders.files(spark, str(root)).persist()
    got = {r.rel: r for r in table.collect()}
    assert {k: v.kind for k, v in got.items()} == {
        "old/a.scpt": "script", "old/_u": "text", "old/sub/Two": "script", "old/notes.txt": "text", "old/sub/deep/s": "stack", "old/z.hqx": "script", "old/bad.scpt": "script",
        "old/disk/Disk/Sub/flat": "script", "old/disk/Disk/inner/Disk/core": "stack",
    }
    assert got["old/sub/Two"].creator == "ToyS" and got["old/disk/Disk/inner/Disk/core"].depth == 2
    objs = decode.objects(table).persist()
    assert objs.groupBy("file_id").count().collect() and {r["count"] for r in objs.groupBy("file_id").count().collect()} == {18}
    assert decode.run_only(objs).count() == 4 and {r.letter for r in decode.roots(objs).collect()} == {"k"}
    code = decode.instructions(table)
    assert code.count() == 16 and decode.invalid_branches(code).count() == 0
    assert decode.handlers(table).select("name").distinct().collect()[0][0] == "Add"
    assert decode.layers(table).count() == 6 and decode.parts(table).count() == 6 and decode.texts(table).count() == 4
    assert decode.resources(table).where("type = 'scpt'").count() == 4
    done = decode.results(table, "disasm").persist()
    assert decode.status(done).first()[0] == 1 and done.where("error is not null").first().rel == "old/bad.scpt" and done.where("out like 'handler Add%'").count() == 4
    decode.write_results(done, str(tmp_path / "out"))
    assert {r.file for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"old/a.disasm.txt", "old/sub/Two.disasm.txt", "old/z.hqx.disasm.txt", "old/disk/Disk/Sub/flat.disasm.txt"}
    listed = {r.rel: r.out for r in decode.results(table, "text").where("out is not null").collect()}
    assert set(listed) == {"old/sub/deep/s", "old/disk/Disk/inner/Disk/core"} and listed["old/sub/deep/s"] == TEXTS
    assert decode.deduped(table).count() < table.count()
    assert os.path.basename(folders.bundle("/x.app")) == "x.app"
