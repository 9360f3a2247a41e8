import struct

from palimpsest.functions import source
from palimpsest.operators import terms
from tests import builders as B
from tests.test_source import Tree


def test_table(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# terms\nFinder\tclass\tdocu\tfile document\n\tproperty\tpnam\tname\n\tclass\tpnam\tname class\nAppleScript\tclass\tpnam\tname of all\nAppleScript\tproperty\tcolr\tcolor\nFinder\tconstant\tpnam\tFinder name\nFinder\tevent\tcoreopen\topen it\n")
    t = terms.load(spark, str(tmp_path / "t.tsv"))
    assert t.where("scope = ''").count() == 2
    codes = spark.createDataFrame([(1, "pnam", None), (2, "pnam", "Finder"), (3, "docu", None), (4, "docu", "Finder"), (5, "colr", "Finder"), (6, "ask ", None)], "key int, code string, scope string")
    got = {r["key"]: r["name"] for r in terms.resolve(codes, t).collect()}
    assert got == {1: "name", 2: "Finder name", 3: "«class docu»", 4: "file document", 5: "color", 6: "«class ask »"}
    assert {r["key"]: r["name"] for r in terms.resolve(codes, t, "class").collect()}[1] == "name class"
    classic = spark.createDataFrame([("Finder", "class", "docu", "old"), ("Finder", "class", "brow", "browser")], "scope string, kind string, code string, name string")
    both = terms.with_classic(t, classic)
    assert both.count() == 8 and terms.dictionaries(both)["Finder"].classes == {"docu": "file document", "brow": "browser"}
    rows = [("A", "class", "x", "late source", 2, 1), ("A", "class", "x", "first", 1, 1), ("A", "class", "x", "second", 1, 2), ("A", "label", "e/x", "first", 1, 1), ("A", "label", "e/x", "second", 1, 2)]
    made = terms.merged(spark.createDataFrame(rows, "scope string, kind string, code string, name string, source_rank int, def_order int"))
    assert {(r.kind, r.name) for r in made.collect()} == {("class", "second"), ("label", "first")}
    paths = spark.createDataFrame([("/System/Applications/Music.app",), ("Finder",), ("Disk:Apps:Script Editor.app:",), ("https://x.example/rpc",)], "a string")
    assert [r[0] for r in paths.select(terms.scope_of(paths["a"])).collect()] == ["Music", "Finder", "Script Editor", "web service"]


def test_printer_uses_the_innermost_application():
    t = Tree()
    app = t.node("4", t.code("capp"), t.text("Painter"))
    inside = t.node("r", t.node("n", t.node("1", t.code("brsh")), t.var("brush")), t.var("x"))
    tell, outside = t.node("O", t.block(inside), app), t.node("r", t.node("1", t.code("brsh")), t.var("y"))
    top = t.block(tell, outside)
    whole = b"FasdUAS 1.101.10" + B.refs(0x0E, 0, [-1, top], 15) + t.out + b"ascr\0\1\0\x0c\xfa\xde\xde\xad"
    known = {"Painter": source.Dictionary(properties={"brsh": "brush"})}
    assert source.decompile(whole, known) == 'tell application "Painter"\n\tset x to brush of |brush|\nend tell\nset y to «class brsh»\n'


def test_symbols_of_version_1():
    t = Tree()
    symbol = t.inline()
    t.out += B.raw(0x01, symbol, struct.pack(">I", 121 * 8 + 1))
    top = t.block(t.node("L", t.node("m", symbol)))
    whole = b"FasdUAS 1.00" + B.refs(0x0E, 0, [-1, top], 15) + t.out + b"ascr\0\1\0\x0c\xfa\xde\xde\xad"
    assert source.decompile(whole) == "return true\n"
