import io
import struct

import pytest

from palimpsest import __main__ as main
from palimpsest.functions import stacks
from tests import builders as B


def test_arguments():
    assert main.arguments(["-e", "Japanese", "text", "a", "-o", "out", "--", "-b"]) == ("text", "Mac Japanese", "out", ["a", "-b"])
    for bad in ([], ["text"], ["fly", "x"], ["text", "-x", "a"], ["text", "a", "-e", "klingon"], ["text", "a", "-o"]):
        with pytest.raises(ValueError):
            main.arguments(bad)


def test_run(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old/s").write_bytes(B.stack())
    (tmp_path / "old/note.txt").write_bytes(b"beep")
    (tmp_path / "old/bad.scpt").write_bytes(B.compiled()[:20])
    call = lambda *a: (main.run(spark, list(a), out := io.StringIO(), err := io.StringIO()), out.getvalue(), err.getvalue())
    code, out, err = call("decompile", str(tmp_path / "old"))
    assert code == 1 and "bad.scpt" in err and out.startswith("==> old/note.txt <==\nbeep\n==> old/s <==\n-- stack\n")
    code, out, err = call("text", str(tmp_path / "old/s"))
    assert code == 0 and out.startswith("-- card field id 3 of card id 12\nown\n") and not err
    assert call("text", str(tmp_path / "old/note.txt"))[0] == 1 and call("text", str(tmp_path / "gone"))[0] == 1 and call("x")[0] == 2
    assert call("decompile", str(tmp_path / "old"), "-o", str(tmp_path / "out"))[1] == ""
    assert {r.file for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"old/note.txt.applescript", "old/s.hypertalk"}
    assert "japanese" in call("encodings")[1]


def test_stack_text_follows_its_fonts():
    fonts = struct.pack(">I4x", 3) + b"".join(struct.pack(">h", i) + n + bytes(1 + (i + len(n)) % 1) + bytes((3 + len(n)) % 2) for i, n in ((3, b"Geneva"), (16384, b"Osaka"), (4, b"Monaco")))
    styles = struct.pack(">I4x", 2) + b"".join(struct.pack(">I8xh10x", i, f) for i, f in ((1, 16384), (2, 3)))
    kana, word = "ひらがなです".encode("shift_jis"), "café".encode("mac_roman")
    runs = struct.pack(">HHHHHHH", 0x8000 | 14, 0, 1, len(kana), 2, 1, 1)
    link = bytearray(24)
    struct.pack_into(">I", link, 20, 7)
    card = B.block(b"CARD", 13, bytes(link) + B.layer([], [(1, runs + kana + word)], "カード".encode("shift_jis").decode("mac_roman"), ""))
    whole = B.stack()
    tail = whole.rindex(b"TAIL") - 4
    data = whole[:tail] + B.block(b"FTBL", 30, fonts) + B.block(b"STBL", 31, styles) + card + whole[tail:]
    data = data.replace(struct.pack(">I4xI4x", 12, 11), struct.pack(">I4xI4x", 13, 11))
    s = stacks.parse(data)
    assert s.cards[0].name == "カード" and s.cards[0].texts[0][1] == "ひらがなですcafé" and s.cards[1].texts[0][1] == "café ⌘"
    assert stacks.parse(data, encoding="Mac Roman").cards[0].name == "カード".encode("shift_jis").decode("mac_roman")
