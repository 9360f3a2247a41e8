"""Bytecode assembled by hand, and the source that it gives back."""

import struct

import pytest

from palimpsest.functions import rebuild, source
from palimpsest.functions.records import OPERATIONS
from tests import builders as B

CODES = {}
for op, (name, n) in sorted(OPERATIONS.items(), reverse=True):
    CODES[name] = (op, n)


def assemble(text: str) -> bytes:
    """Lines of a mnemonic and its words; a word >name is a branch to the line name:, counted from the byte after the opcode."""
    rows, labels, at = [], {}, 0
    for line in text.strip().splitlines():
        word, *args = line.split()
        if word.endswith(":"):
            labels[word[:-1]] = at
            continue
        name, _, packed = word.partition(".")
        op, n = CODES[name]
        if packed:
            op, n = op - op % (32 if name == "PushLiteral" else 16) + int(packed), 0
        rows.append((at, op, args))
        at += 1 + 2 * len(args)
    return b"".join(bytes([op]) + b"".join(struct.pack(">h", labels[a[1:]] - at - 1 if a[0] == ">" else int(a)) for a in args) for at, op, args in rows)


def script(code: str, names: list[str], literals: list, params: list[str] = ()) -> str:
    """A script of one handler, work(params), rebuilt. Literals: numbers, 'names', \"texts\", (code,) terms, [events]."""
    out, ref = [], [20]

    def new() -> int:
        ref[0] += 1
        return ref[0]

    def value(v) -> int:
        r = new()
        if isinstance(v, int):
            out.append(B.number(r, v))
        elif isinstance(v, tuple):
            out.append(B.raw(0x0A, r, v[0].encode(), 0x0A))
        elif isinstance(v, list):
            out.append(B.raw(0x0A, r, v[0].encode() + bytes(12), 0x2E))
        elif isinstance(v, dict):
            tail = 1
            for k, w in reversed(v.items()):
                cell = new()
                out.append(B.refs(0x06, cell, [value((k,)), value(w), tail]))
                tail = cell
            return tail
        elif v.startswith('"'):
            t = new()
            out.append(B.raw(0x11, t, v.strip('"').encode("utf-16-be")) + B.refs(0x0E, r, [t], 0xB1))
        else:
            out.append(B.word(r, v))
        return r

    given = new()
    count, held = new(), new()
    out.append(B.number(count, len(params)) + B.refs(0x0E, held, [value(p) for p in params], 0) + B.refs(0x0E, given, [count, held], 4))
    own, lits, name = new(), new(), value("work")
    out.append(B.refs(0x10, own, [value(n) for n in [*params, *names]]) + B.refs(0x10, lits, [value(v) for v in literals]) + B.raw(0x11, 8, assemble(code)))
    body = B.refs(0x0E, 0, [1, 1, 2], 15) + B.raw(0x01, 1, b"") + B.refs(0x10, 2, [1, 1, 3]) + B.refs(0x0E, 3, [name, 1, given if params else 1, 1, own, lits, 8], 16) + b"".join(out)
    whole = b"FasdUAS 1.101.10" + body + b"ascr\0\1\0\x0c\xfa\xde\xde\xad"
    text = source.decompile(whole)
    assert text.startswith(rebuild.HEADING) and text.endswith("end work\n")
    head, *lines, _ = text.removeprefix(rebuild.HEADING).splitlines()
    assert head == f"on work({', '.join(params)})"
    return "\n".join(x.removeprefix("\t") for x in lines)


def test_the_small_script():
    assert source.decompile(B.compiled()) == rebuild.HEADING + "on Add(x)\n\tx + -2\nend Add\n"


def test_branches():
    code = """PushVariable.0\nPush1\nLessThanOrEqual\nTestIf >else\nPush1\nReturn\nPop\nJump >end\nelse:\nPushVariable.0\nPush2\nEqual\nTestIf >last
    Push2\nPopVariable.1\nStoreResult\nJump >end\nlast:\nPush3\nPopVariable.1\nStoreResult\nend:\nPushVariable.1\nReturn\nPush0\nReturn"""
    assert script(code, ["y"], [], ["x"]) == "if x ≤ 1 then\n\treturn 1\nelse if x = 2 then\n\tset y to 2\nelse\n\tset y to 3\nend if\nreturn y\n0"


def test_loops_and_locals():
    code = """Push1\nPushLiteral.0\nPush1\nPushUndefined\nLinkRepeat >end\nPush1\nPushLiteral.0\nPush2\nPushUndefined\ntop:\nRepeatInRange 0\nPushVariable.0\nPopVariable.1\nDup\nStoreResult\nJump >top\nend:\nReturn"""
    assert script(code.replace("Push1\nPushLiteral.0\nPush1\nPushUndefined\nLinkRepeat", "LinkRepeat"), ["i", "t"], [10]) == "repeat with i from 1 to 10 by 2\n\tset t to i\nend repeat"
    swapped = script("Push1\nPopVariable.1\nStoreResult\nPush2\nPopVariable.0\nReturn", ["a", "b"], [])
    assert swapped == "local a\nset b to 1\nset a to 2" or swapped == "local a, b\nset b to 1\nset a to 2"
    code = "LinkRepeat >end\nPushUndefined\ntop:\nPushVariable.0\nPush3\nLessThan\nRepeatWhile\nPop\nPush1\nPopVariable.0\nDup\nStoreResult\nJump >top\nend:\nReturn"
    assert script(code, ["n"], []) == "repeat while n < 3\n\tset n to 1\nend repeat"


def test_try_tell_and_commands():
    code = """ErrorHandler >handler\nPushIt\nPushLiteral.1\nPushLiteral.2\nPush2\nMessageSend 0\nPopVariable.0\nStoreResult\nEndErrorHandler >end\nhandler:\nHandleError 3 4\nPushMe\nPush0\nPushVariable.1\nError
    end:\nPushIt\nPushLiteral.5\nPushLiteral.6\nMakeObjectAlias.3\nTell 7\nPushIt\nPushLiteral.7\nMakeObjectAlias.0\nGetData\nPopVariable.0\nStoreResult\nEndTell\nReturn"""
    got = script(code.replace("MakeObjectAlias.3", "ALIAS3").replace("MakeObjectAlias.0", "MakeObjectAlias").replace("ALIAS3", "MakeObjectAlias3"), ["r", "m", "n"], [["sysodlog"], ("btns",), '"OK"', "m", {"errn": "n"}, ("capp",), '"Finder"', ("pnam",)])
    assert got == 'try\n\tset r to display dialog buttons "OK"\non error m number n\n\terror m\nend try\ntell application (get "Finder")\n\tset r to name\nend tell'


CODES["MakeObjectAlias"], CODES["MakeObjectAlias3"] = (0x2C, 0), (0x2F, 0)


def test_lists_folds_and_conditions():
    code = """PushVariable.0\nDup\nPushLiteral.0\nPush1\nMakeObjectAlias3\nGetData\nPopVariable.1\nStoreResult\nDup\nPushLiteral.0\nPush2\nMakeObjectAlias3\nGetData\nPopVariable.2\nStoreResult\nStoreResult
    PushVariable.1\nAnd >right\nPushVariable.2\nPushLiteral.1\nCoerce\nright:\nNot\nPopVariable.3\nStoreResult\nPushVariable.1\nPushLiteral.2\nPush2\nMakeVector\nReturn"""
    assert script(code, ["a", "b", "c"], [("cobj",), ("bool",), '"x"'], ["l"]) == 'set {a, b} to l\nset c to not (a and b)\n{a, "x"}'


@pytest.mark.parametrize("code", ["Pop\nAdd\nReturn", "Jump >x\nx:\nReturn", "EndOf\nReturn", "ErrorHandler >x\nx:\nReturn"])
def test_what_fits_no_shape_is_said(code):
    with pytest.raises(rebuild.Unsupported):
        script(code, [], [])
