import plistlib
import struct

import pytest

from palimpsest.functions import encodings as E, forks, records
from tests import builders as B


@pytest.mark.parametrize(("texts", "fonts", "want"), [
    (["ファイル".encode("shift_jis"), b"plain"], None, "japanese"),
    (["あい".encode("shift_jis")] * 10 + [b"caf\xe9"], None, "japanese"),
    (["Frédéric Rinaldi".encode("mac_roman")], None, "roman"),
    (["haven’t".encode("mac_roman"), "“Build”".encode("mac_roman"), "© 1994".encode("mac_roman")], None, "roman"),
    (["Électromécanicien".encode("mac_roman"), "Prüfungszeugnis Gerätetechnik".encode("mac_roman")] * 5, None, "roman"),
    (["的是一".encode("gb2312")], ["Mac Chinese Simplified"], "chinese-simplified"),
    (["이다".encode("euc_kr")], ["Mac Korean"], "korean"),
    (["Спасибо".encode("mac_cyrillic"), "Привет".encode("mac_cyrillic")], ["Mac Cyrillic"], "cyrillic"),
    (["café".encode("mac_roman")], ["Mac Cyrillic"], "roman"),
    (["Bilgisayarınıza konuşmayı taşıyın".encode("mac_turkish")], None, "turkish"),
    (["자동으로 열려고".encode("euc_kr")], None, "korean"),
    (["Дисплей".encode("mac_cyrillic"), "Звук и Мониторы".encode("mac_cyrillic")], None, "cyrillic"),
    (["Файл".encode("mac_cyrillic")], [], "roman"),
    ([b"", b"ascii"], None, "roman"),
])
def test_detect(texts, fonts, want):
    assert E.detect(texts, fonts) == E.by_name(want)


def test_names_and_fonts():
    assert [E.by_name(x) for x in ("MacCyrillic", "Central European", "chinese_traditional", "klingon")] == ["Mac Cyrillic", "Mac Central European", "Mac Chinese Traditional", None]
    got = [E.for_font(i, n) for i, n in ((16384, b"Osaka"), (3, b"Osaka"), (28672, b"*Beijing*"), (27710, b"Times New Roman"), (3, b"Geneva"), (2, b"Chicago CE"), (16385, "細明朝体".encode("shift_jis")))]
    assert got == ["Mac Japanese", "Mac Japanese", "Mac Chinese Simplified", None, None, "Mac Central European", "Mac Japanese"]
    assert [E.wide_in_word(s) for s in ("Fr仕屍ic", "Menuの削除", "1994 年 4 月")] == [True, False, False]
    assert E.encode_roman("日本") is None and E.decode(b"haven\xd5t", "Mac Japanese") == "haven’t" and E.decode(b"\xff\xff", "Mac Korean") is None


def test_jxa():
    held = plistlib.dumps({"script": "var a\r\nb\rc"}, fmt=plistlib.FMT_BINARY)
    b = b"JsOsaDAS1.001.00" + held + b"jscr\0\1\0\x0c\xfa\xde\xde\xad"
    assert forks.kind(b) == "jxa" and forks.jxa(b) == "var a\nb\nc"
    for cut in range(16, len(b), 7):
        with pytest.raises(ValueError):
            forks.jxa(b[:cut][: len(held)])


def test_tree():
    assert records.tree(records.records(records.body(B.compiled())[1])) == "#20 'k' flags=0x1 pos=2-3 [21 -1]\n  #21 'o' flags=0x0 pos=0-0 []\n  -1\n"


KANA = "これはひらがなのながいぶんしょうです".encode("shift_jis")


def test_scripts_old_strings_show_their_encoding():
    string = lambda ref, b: B.raw(0x0C, ref, struct.pack(">H", len(b)) + b + bytes(len(b) % 2))
    made = lambda *bs: records.records(b"".join(string(k + 5, b) for k, b in enumerate(bs)))
    assert records.old_strings(made(KANA, b"x")) == [KANA, b"x"]
    assert records.script_encoding(made(KANA)) == "Mac Japanese" and records.script_encoding(made("café".encode("mac_roman"))) == E.ROMAN
    assert records.script_encoding(made(KANA, "«class cfol»".encode("mac_roman"))) == E.ROMAN
    rows = made(KANA)
    with records.reading(rows):
        assert records.old_text(KANA) == KANA.decode("shift_jis")
    with records.reading(rows, E.ROMAN):
        assert records.old_text(KANA) == KANA.decode("mac_roman")
    assert records.old_text(KANA) == KANA.decode("mac_roman")


def test_volumes_names_show_their_encoding():
    from palimpsest.functions import images

    listed = lambda volume: {f.path[-1] for v in images.volumes(images.Part.of(volume)) for f in v.files}
    names = [f"ひらがなのなまえ{k}" for k in range(4)]
    old = lambda x: x.encode("shift_jis").decode("mac_roman")
    assert listed(B.disk(False, [(old(x), b"data", b"") for x in names])) == set(names)
    assert listed(B.disk(False, [("café ⌘".replace("⌘", "†"), b"x", b"")])) == {"café †"}
