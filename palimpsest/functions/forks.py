"""Files with two forks: their wrappers (AppleSingle and AppleDouble, BinHex 4.0, MacBinary) and resource forks."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass


@dataclass
class Forked:
    name: str = ""
    type: str = ""
    creator: str = ""
    data: bytes = b""
    rsrc: bytes = b""


def roman(b: bytes) -> str:
    return b.decode("mac_roman")


def four(b: bytes) -> str:
    """A four-character code, empty if it is all zero."""
    return roman(b) if any(b) else ""


def apple_single(b: bytes) -> Forked | None:
    if len(b) < 26 or b[:4] not in (b"\x00\x05\x16\x00", b"\x00\x05\x16\x07"):
        return None
    f = Forked()
    (count,) = struct.unpack_from(">H", b, 24)
    for k in range(min(count, (len(b) - 26) // 12)):
        what, at, size = struct.unpack_from(">III", b, 26 + 12 * k)
        if at + size > len(b):
            continue
        part = b[at : at + size]
        if what == 1:
            f.data = part
        elif what == 2:
            f.rsrc = part
        elif what == 3:
            f.name = roman(part)
        elif what == 9 and size >= 8:
            f.type, f.creator = four(part[:4]), four(part[4:8])
    return f


def mac_binary(b: bytes) -> Forked | None:
    if len(b) < 128 or b[0] or b[74] or b[82] or not 0 < b[1] < 64:
        return None
    n_data, n_rsrc = struct.unpack_from(">II", b, 83)
    second = 128 + -(-n_data // 128) * 128
    if 128 + n_data > len(b) or second + n_rsrc > len(b) or max(n_data, n_rsrc) >> 31:
        return None
    return Forked(roman(b[2 : 2 + b[1]]), four(b[65:69]), four(b[69:73]), b[128 : 128 + n_data], b[second : second + n_rsrc])


_HQX = bytes(c for c in range(0x21, 0x73) if c not in b"./7:;<=>?OW\\]^_gno")
_HQX_DROP = bytes(c for c in range(256) if c not in _HQX)
_HQX_VALUE = bytes(_HQX.index(c) if c in _HQX else 0 for c in range(256))


def _unrun(b: bytes) -> bytes | None:
    """0x90 n stands for n of the byte before it in all; 0x90 0 is a 0x90."""
    out = bytearray()
    at = 0
    while (mark := b.find(0x90, at)) >= 0:
        out += b[at:mark]
        if mark + 1 == len(b):
            out.append(0x90)
            return bytes(out)
        times = b[mark + 1]
        if times == 0:
            out.append(0x90)
        elif not out:
            return None
        else:
            out += out[-1:] * (times - 1)
        at = mark + 2
    return bytes(out + b[at:])


def bin_hex(b: bytes) -> Forked | None:
    told = b.find(b"(This file must be converted with BinHex")
    colon = b.find(b":", told) if told >= 0 else -1
    if colon < 0:
        return None
    digits = b[colon + 1 :].partition(b":")[0].translate(_HQX_VALUE, _HQX_DROP)
    bits = "".join(f"{d:06b}" for d in digits)
    raw = _unrun(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits) - 7, 8)))
    if not raw or len(raw) < raw[0] + 22:
        return None
    p = raw[0] + 2
    n_data, n_rsrc = struct.unpack_from(">II", raw, p + 10)
    first = p + 20
    second = first + n_data + 2
    if second + n_rsrc > len(raw):
        return None
    return Forked(roman(raw[1 : 1 + raw[0]]), four(raw[p : p + 4]), four(raw[p + 4 : p + 8]), raw[first : first + n_data], raw[second : second + n_rsrc])


def unwrap(b: bytes) -> Forked | None:
    """The file in a wrapper; None if b is in none."""
    return apple_single(b) or bin_hex(b) or mac_binary(b)


def resources(fork: bytes) -> list[tuple[str, int, str, bytes]]:
    """type, id, name and data of all resources, in the order of the fork's map. A type's list ends
    at a reference that was read before, so that a damaged map can't list its resources over and over."""
    if len(fork) < 16:
        return []
    data_at, map_at = struct.unpack_from(">II", fork)
    if map_at + 28 > len(fork) or data_at > len(fork):
        return []
    here = fork[map_at:]
    types_at, names_at = struct.unpack_from(">HH", here, 24)
    types = here[types_at:]
    if len(types) < 2:
        return []
    out, read = [], set()
    (most,) = struct.unpack_from(">h", types)
    for k in range(min(most + 1, (len(types) - 2) // 8)):
        kind, more, refs = struct.unpack_from(">4shH", types, 2 + 8 * k)
        for at in range(refs, refs + 12 * (more + 1), 12):
            if at + 12 > len(types) or at in read:
                break
            read.add(at)
            number, name_at, place = struct.unpack_from(">hhI", types, at)
            start = data_at + (place & 0xFFFFFF)
            if start + 4 > len(fork):
                continue
            (size,) = struct.unpack_from(">I", fork, start)
            if start + 4 + size > len(fork):
                continue
            name = ""
            if name_at >= 0 and (p := names_at + name_at) < len(here) and p + 1 + here[p] <= len(here):
                name = roman(here[p + 1 : p + 1 + here[p]])
            out.append((roman(kind), number, name, fork[start + 4 : start + 4 + size]))
    return out


_FASD = re.compile(rb"FasdUAS (\d\.\d\d)")


def fasd_header(b: bytes) -> int:
    """Length of a compiled script's header: 12 before version 1.10, else 16; 0 if b has none."""
    m = _FASD.match(b)
    if not m:
        return 0
    if m[1] < b"1.10":
        return 12
    return 16 if re.match(rb"\d\.\d\d", b[12:16]) else 0


def script_resource(fork: bytes) -> bytes | None:
    """The compiled script of a resource fork: scpt 128, else the first scpt or other resource that
    starts like one, in the map's order."""
    found = [r for r in resources(fork) if fasd_header(r[3])]
    found.sort(key=lambda r: not (r[0] == "scpt" and r[1] == 128))
    return found[0][3] if found else None


def is_plain(b: bytes) -> bool:
    if 0 in b:
        return False
    try:
        b.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def kind(data: bytes, rsrc: bytes = b"") -> str:
    """stack, project, jxa, script, text or other, by the bytes alone."""
    from palimpsest.functions.projects import project_bytes

    if data[4:8] == b"STAK":
        return "stack"
    if project_bytes(data) is not None:
        return "project"
    if data.startswith(b"JsOsaDAS"):
        return "jxa"
    if fasd_header(data) or fasd_header(re.sub(rb"\A#![^\n\r]*[\n\r]", b"", data)) or script_resource(rsrc):
        return "script"
    return "text" if data and is_plain(data) else "other"


def jxa(b: bytes) -> str:
    """The source of a compiled JavaScript: a binary property list between a header and a trailer."""
    import plistlib

    rest = b[16:]
    if b.endswith(b"\xfa\xde\xde\xad") and 0 < (n := int.from_bytes(b[-6:-4], "big")) <= len(rest):
        rest = rest[:-n]
    if len(rest) < 40 or not rest.startswith(b"bplist00"):
        raise ValueError("no property list")
    try:
        held = plistlib.loads(rest)
    except Exception as e:
        raise ValueError(f"a damaged property list: {e}") from e
    if not isinstance(held, dict) or not isinstance(held.get("script"), str):
        raise ValueError("no source in the property list")
    return held["script"].replace("\r\n", "\n").replace("\r", "\n")
