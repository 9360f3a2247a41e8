"""A script that an old system compiled, in every wrapper, against digests of its known source; and files
found by random search that once broke decoders."""

import base64
import hashlib
import json
import pathlib
import re

import pytest

from palimpsest.functions import forks
from palimpsest.operators import decode
from tests import builders as B

DATA = pathlib.Path(__file__).parent / "data"
FORK = (DATA / "classic.rsrc").read_bytes()
SEEDS = [(kind, base64.b64decode(x)) for kind, xs in json.loads((DATA / "seeds.json").read_text()).items() for x in xs]
WRAPPED = {
    "fork alone": (b"", FORK), "BinHex": (B.bin_hex("Classic Script", b"osasToyS", b"", FORK), b""), "MacBinary": (B.mac_binary("Classic Script", b"osasToyS", b"", FORK), b""),
    "AppleDouble": (B.apple_double(FORK), b""), "AppleSingle": (B.apple_double(FORK, data=b""), b""),
}


def digest(text: str, head: str = "") -> str:
    lines = [x for x in (re.sub(r"[ \t\r]+$", "", y) for y in text.split("\n")) if x]
    start = next(k for k, x in enumerate(lines) if x.startswith(head))
    return hashlib.sha256("\n".join(lines[start:]).encode()).hexdigest()


@pytest.mark.parametrize("name", list(WRAPPED))
def test_script_in_every_wrapper(name):
    data, rsrc = WRAPPED[name]
    inside = forks.unwrap(data) if data else None
    data, rsrc = (inside.data, inside.rsrc) if inside else (data, rsrc)
    assert forks.kind(data, rsrc) == "script"
    assert digest(decode.output("script", "decompile", data, rsrc)[0]) == "10e43148b4c4658d9d59902f5b271d565071a61148c08a68294e6d1ab99a000e"
    assert digest(decode.output("script", "bytecode", data, rsrc)[0], "on ") == "276a5954fdf5c822d99dfea74aa6a20a572e755823c05c3f53d4c80f82fe95d1"
    assert len(decode.output("script", "disasm", data, rsrc)[0]) > 1000 and len(decode.output("script", "tree", data, rsrc)[0]) > 1000


@pytest.mark.parametrize("k", range(len(SEEDS)))
def test_found_files_give_an_output_or_an_error(k):
    kind, data = SEEDS[k]
    inside = forks.unwrap(data)
    data, rsrc = (inside.data, inside.rsrc) if inside else (data, b"")
    for command in ("decompile", "bytecode", "text", "tree", "disasm"):
        for as_kind in {forks.kind(data, rsrc), "script" if kind != "stack" else "stack"}:
            out, error = decode.output(as_kind, command, data, rsrc)
            assert out is None or error is None


def test_results_of_real_files_as_a_table(spark):
    rows = [(n, n, bytearray(d), bytearray(r), "script", None) for n, (d, r) in (("fork", (b"", FORK)),)] * 3
    files = spark.createDataFrame(rows, "file_id string, rel string, data binary, rsrc binary, kind string, error string")
    got = decode.results(files, "decompile").collect()
    assert len(got) == 3 and all(digest(r.out) == "10e43148b4c4658d9d59902f5b271d565071a61148c08a68294e6d1ab99a000e" for r in got)
