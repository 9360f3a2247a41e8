"""Disk images and the HFS and HFS+ volumes on them, read from any seekable source by parts."""

from __future__ import annotations

import base64
import bz2
import re
import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from io import BytesIO

from palimpsest.functions.encodings import decode_or_roman, detect
from palimpsest.functions.forks import resources, roman

MOST_CHUNK = 64 << 20
DEEPEST, CLIMB, MOST_ENTRIES = 4, 100, 256


class NotAnImage(ValueError):
    """Not a disk image at all."""


class NoVolume(ValueError):
    """A disk image, but without a volume that can be read."""


class Part:
    """A range of bytes of a seekable source, or of another part."""

    def __init__(self, source, at: int = 0, size: int | None = None):
        self.source, self.at = source, at
        self.size = size if size is not None else source.seek(0, 2)

    @staticmethod
    def of(b: bytes) -> Part:
        return Part(BytesIO(b))

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes, fewer at the end."""
        n = min(n, self.size - at)
        if at < 0 or n <= 0:
            return b""
        if hasattr(self.source, "seek"):
            self.source.seek(self.at + at)
            return self.source.read(n)
        return self.source.read(self.at + at, n)

    def whole(self, at: int, n: int) -> bytes:
        got = self.read(at, n)
        if len(got) < n:
            raise NoVolume(f"{n} bytes at {at} go past the end")
        return got


@dataclass(order=True)
class Chunk:
    sector: int
    count: int
    how: str = field(compare=False)
    at: int = field(compare=False)
    size: int = field(compare=False)


def adc(b: bytes, most: int) -> bytes:
    """Apple Data Compression: literals of up to 128 bytes, copies of 3 to 67 from up to 65536 back."""
    out = bytearray()
    at = 0
    while at < len(b) and len(out) < most:
        c = b[at]
        if c & 0x80:
            n = (c & 0x7F) + 1
            out += b[at + 1 : at + 1 + n]
            at += 1 + n
            continue
        if c & 0x40:
            if at + 2 >= len(b):
                break
            n, back, at = (c & 0x3F) + 4, struct.unpack_from(">H", b, at + 1)[0] + 1, at + 3
        else:
            if at + 1 >= len(b):
                break
            n, back, at = (c >> 2 & 15) + 3, ((c & 3) << 8 | b[at + 1]) + 1, at + 2
        if back > len(out):
            continue
        unit = bytes(out[-back:])
        out += (unit * (n // back + 1))[:n]
    return bytes(out[:most])


class Chunked:
    """A disk whose sectors are stored in chunks, each unpacked when it is asked for; the last stays."""

    def __init__(self, source: Part, chunks: list[Chunk]):
        self.source, self.chunks = source, sorted(chunks)
        for c in self.chunks:
            if c.count < 0 or c.sector < 0 or c.count * 512 > MOST_CHUNK or not 0 <= c.size <= MOST_CHUNK:
                raise NoVolume(f"a chunk of {c.count} sectors")
        self.starts = [c.sector for c in self.chunks]
        self.size = max((512 * (c.sector + c.count) for c in self.chunks), default=0)
        self.held: tuple[int, bytes] = (-1, b"")

    def unpack(self, k: int) -> bytes:
        if self.held[0] != k:
            c = self.chunks[k]
            size = 512 * c.count
            raw = b"" if c.how == "zero" else self.source.read(c.at, c.size)
            try:
                if c.how == "adc":
                    raw = adc(raw, size)
                elif c.how == "zlib" and raw:
                    raw = zlib.decompressobj().decompress(raw, size)
                elif c.how == "bzip2" and raw:
                    raw = bz2.BZ2Decompressor().decompress(raw, size)
                elif c.how == "unknown":
                    raise NoVolume(f"the chunk at sector {c.sector} is packed in an unknown way")
            except (zlib.error, OSError) as e:
                raise NoVolume(f"the chunk at sector {c.sector}: {e}") from e
            self.held = (k, raw[:size].ljust(size, b"\0"))
        return self.held[1]

    def read(self, at: int, n: int) -> bytes:
        out = bytearray()
        n = min(n, self.size - at)
        while len(out) < n:
            pos = at + len(out)
            k = bisect_right(self.starts, pos // 512) - 1
            if k >= 0 and pos < 512 * (self.chunks[k].sector + self.chunks[k].count):
                data = self.unpack(k)
                start = pos - 512 * self.chunks[k].sector
                out += data[start : start + n - len(out)]
            else:  # a gap reads as zeros
                end = 512 * self.starts[k + 1] if k + 1 < len(self.starts) else self.size
                out += bytes(min(end - pos, n - len(out)))
        return bytes(out)


@dataclass
class Fork:
    size: int
    extents: list[tuple[int, int]]


@dataclass
class VolumeFile:
    path: list[str]
    type: str
    creator: str
    ident: int
    data: Fork
    rsrc: Fork


@dataclass
class Volume:
    source: Part
    plus: bool
    block: int
    start: int
    name: str = ""
    files: list[VolumeFile] = field(default_factory=list)
    overflow: dict[tuple[int, bool], list[tuple[int, int]]] = field(default_factory=dict)

    def fork(self, ident: int, is_rsrc: bool, f: Fork, most: int | None = None) -> bytes:
        """A fork's bytes: its extents in order, then those in the overflow file if they are too few."""
        if f.size > self.source.size or most is not None and f.size > most:
            raise NoVolume(f"a fork of {f.size} bytes")
        extents = f.extents
        if sum(n for _, n in extents) * self.block < f.size:
            extents = extents + self.overflow.get((ident, is_rsrc), [])
        out = bytearray()
        for first, n in extents:
            want = min(n * self.block, f.size - len(out))
            if want <= 0:
                break
            got = self.source.read(self.start + first * self.block, want)
            out += got
            if len(got) < want:
                break
        if len(out) < f.size:
            raise NoVolume(f"a fork has {len(out)} of its {f.size} bytes")
        return bytes(out)

    def read_data(self, f: VolumeFile, most: int | None = None) -> bytes:
        return self.fork(f.ident, False, f.data, most)

    def read_rsrc(self, f: VolumeFile, most: int | None = None) -> bytes:
        return self.fork(f.ident, True, f.rsrc, most)


def leaves(tree: bytes):
    """The records of a B-tree's leaves, from the first leaf on along their links."""
    if not tree:
        return
    if len(tree) < 512:
        raise NoVolume("a tree is too short")
    (size,) = struct.unpack_from(">H", tree, 32)
    if not 512 <= size <= len(tree):
        raise NoVolume(f"a tree has nodes of {size} bytes")
    (at,) = struct.unpack_from(">I", tree, 24)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        node = tree[at * size : (at + 1) * size]
        if len(node) < size or node[8] != 0xFF:
            raise NoVolume(f"tree node {at} is no leaf")
        (count,) = struct.unpack_from(">H", node, 10)
        count = min(count, size // 2 - 8)
        offsets = struct.unpack_from(f">{count + 1}H", node, size - 2 * (count + 1))[::-1]
        for a, b in zip(offsets, offsets[1:]):
            if 14 <= a < b <= size:
                yield node[a:b]
        (at,) = struct.unpack_from(">I", node)


def _pairs(b: bytes, form: str, n: int) -> list[tuple[int, int]]:
    return [(s, c) for s, c in struct.iter_unpack(form, b[:n]) if c]


def _climb(ident: int, folders: dict[int, tuple[int, str]]) -> list[str]:
    path: list[str] = []
    while ident != 2 and ident in folders and len(path) < CLIMB:
        ident, name = folders[ident]
        path.insert(0, name)
    return path


def hfs(source: Part) -> Volume:
    """A classic volume, or the HFS+ volume that it only wraps."""
    head = source.whole(1024, 162)
    (block,) = struct.unpack_from(">I", head, 0x14)
    start = 512 * struct.unpack_from(">H", head, 0x1C)[0]
    if not block or block % 512:
        raise NoVolume(f"blocks of {block} bytes")
    if head[0x7C:0x7E] == b"H+":
        first, n = struct.unpack_from(">HH", head, 0x7E)
        return hfs_plus(Part(source, start + first * block, n * block))
    label = head[0x25 : 0x25 + min(head[0x24], 27)]
    v = Volume(source, False, block, start)

    def fork(at: int) -> Fork:
        return Fork(struct.unpack_from(">I", head, at)[0], _pairs(head[at + 4 : at + 16], ">HH", 12))

    for rec in leaves(v.fork(3, False, fork(0x82))):
        if len(rec) >= 20 and rec[0] >= 7:
            key = (struct.unpack_from(">I", rec, 2)[0], rec[1] == 0xFF)
            v.overflow.setdefault(key, []).extend(_pairs(rec[8:20], ">HH", 12))
    folders: dict[int, tuple[int, bytes]] = {}
    found: list[tuple[int, bytes, VolumeFile]] = []
    for rec in leaves(v.fork(4, False, fork(0x92))):
        if len(rec) < 7 or rec[0] < 6 or 1 + rec[0] > len(rec) or 6 + rec[6] > rec[0]:
            continue
        (parent,) = struct.unpack_from(">I", rec, 2)
        name = rec[7 : 7 + rec[6]]
        d = rec[(2 + rec[0]) & ~1 :]
        if d[:1] == b"\1" and len(d) >= 10:
            folders[struct.unpack_from(">I", d, 6)[0]] = (parent, name)
        elif d[:1] == b"\2" and len(d) >= 98:
            ident, n_data, n_rsrc = (struct.unpack_from(">I", d, k)[0] for k in (20, 26, 36))
            forks = Fork(n_data, _pairs(d[74:86], ">HH", 12)), Fork(n_rsrc, _pairs(d[86:98], ">HH", 12))
            found.append((parent, name, VolumeFile([], roman(d[4:8]), roman(d[8:12]), ident, *forks)))
    # names don't tell their encoding: all of the volume together show it
    encoding = detect([label, *(n for _, n in folders.values()), *(n for _, n, _ in found)])
    v.name, folders = decode_or_roman(label, encoding), {k: (p, decode_or_roman(n, encoding)) for k, (p, n) in folders.items()}
    for parent, name, f in found:
        f.path = [*_climb(parent, folders), decode_or_roman(name, encoding)]
        v.files.append(f)
    return v


def hfs_plus(source: Part) -> Volume:
    head = source.whole(1024, 512)
    (block,) = struct.unpack_from(">I", head, 40)
    if block < 512 or block & (block - 1):
        raise NoVolume(f"blocks of {block} bytes")
    v = Volume(source, True, block, 0)

    def fork(b: bytes) -> Fork:
        return Fork(struct.unpack_from(">Q", b)[0], _pairs(b[16:80], ">II", 64))

    for rec in leaves(v.fork(3, False, fork(head[192:]))):
        if len(rec) >= 76 and struct.unpack_from(">H", rec)[0] >= 10:
            key = (struct.unpack_from(">I", rec, 4)[0], rec[2] == 0xFF)
            v.overflow.setdefault(key, []).extend(_pairs(rec[12:76], ">II", 64))
    folders: dict[int, tuple[int, str]] = {}
    found: list[tuple[int, str, VolumeFile]] = []
    for rec in leaves(v.fork(4, False, fork(head[272:]))):
        if len(rec) < 8:
            continue
        size, parent, n = struct.unpack_from(">HIH", rec)
        if size < 6 or 2 + size > len(rec) or 6 + 2 * n > size:
            continue
        name = rec[8 : 8 + 2 * n].decode("utf-16-be", "replace")
        d = rec[2 + size :]
        what = struct.unpack_from(">H", d)[0] if len(d) >= 2 else 0
        if what == 1 and len(d) >= 12:
            folders[struct.unpack_from(">I", d, 8)[0]] = (parent, name)
            if parent == 1:
                v.name = name
        elif what == 2 and len(d) >= 248:
            found.append((parent, name, VolumeFile([], roman(d[48:52]), roman(d[52:56]), struct.unpack_from(">I", d, 8)[0], fork(d[88:]), fork(d[168:]))))
    for parent, name, f in found:
        f.path = [*_climb(parent, folders), name]
        if not any(p.startswith("\0") for p in f.path):  # links' own folder isn't one that a user sees
            v.files.append(f)
    return v


def ndif(layout: bytes, size: int) -> list[Chunk]:
    """Chunks of a Disk Copy 6 image; each ends where the next begins."""
    if len(layout) < 0x80:
        raise NoVolume("the layout is too short")
    (sectors,), (n,) = struct.unpack_from(">I", layout, 0x44), struct.unpack_from(">I", layout, 0x7C)
    rows = [(int.from_bytes(e[:3], "big"), e[3], *struct.unpack(">II", e[4:])) for k in range(min(n, (len(layout) - 0x80) // 12)) if (e := layout[0x80 + 12 * k : 0x8C + 12 * k])]
    stop = next((k for k, r in enumerate(rows) if r[1] == 0xFF), len(rows))
    ends = [r[0] for r in rows[1:]] + [sectors]
    out = []
    for (first, how, at, length), end in zip(rows[:stop], ends):
        if end > first:
            named = {0: "zero", 1: "zero", 2: "raw", 0x83: "adc"}.get(how, "unknown")
            if named != "zero" and at + length > size:
                raise NoVolume("a chunk goes past the end of the image")
            out.append(Chunk(first, end - first, named, at, length))
    return out


_UDIF = {0: "zero", 2: "zero", 1: "raw", 0x80000004: "adc", 0x80000005: "zlib", 0x80000006: "bzip2"}


def udif(source: Part, trailer: bytes) -> Chunked:
    (data_at,), (xml_at, xml_n) = struct.unpack_from(">Q", trailer, 24), struct.unpack_from(">QQ", trailer, 216)
    if not 0 < xml_n <= MOST_CHUNK or xml_at + xml_n > source.size:
        raise NoVolume("an image without a table of chunks")
    chunks = []
    for m in re.finditer(rb"<data>(.*?)</data>", source.read(xml_at, xml_n), re.S):
        try:
            t = base64.b64decode(re.sub(rb"\s+", b"", m[1]), validate=True)
        except ValueError:
            continue
        if len(t) < 204 or t[:4] != b"mish":
            continue
        (first,), (base,), (n,) = struct.unpack_from(">Q", t, 8), struct.unpack_from(">Q", t, 24), struct.unpack_from(">I", t, 200)
        for k in range(min(n, (len(t) - 204) // 40)):
            how, _, sector, count, at, size = struct.unpack_from(">IIQQQQ", t, 204 + 40 * k)
            if how not in (0x7FFFFFFE, 0xFFFFFFFF) and count:
                chunks.append(Chunk(first + sector, count, _UDIF.get(how, "unknown"), data_at + base + at, size))
    if not chunks:
        raise NoVolume("an image without chunks")
    return Chunked(source, chunks)


def _apm(source: Part, head: bytes, depth: int) -> list[Volume]:
    size = struct.unpack_from(">H", head, 2)[0] if head[:2] == b"ER" and head[512:514] != b"PM" else 512
    out, n, k = [], 1, 1
    while size >= 512 and k <= n and k < MOST_ENTRIES:
        e = source.read(k * size, 512)
        if len(e) < 512 or e[:2] != b"PM":
            break
        if k == 1:
            (n,) = struct.unpack_from(">I", e, 4)
        first, count = (x * size for x in struct.unpack_from(">II", e, 8))
        if e[48:80].partition(b"\0")[0] in (b"Apple_HFS", b"Apple_HFSX") and 0 < first < source.size:
            out += _try(source, first, min(count, source.size - first), depth)
        k += 1
    return out


def _gpt(source: Part, head: bytes, depth: int) -> list[Volume]:
    (at,), (n, size) = struct.unpack_from("<Q", head, 72), struct.unpack_from("<II", head, 80)
    out = []
    if 128 <= size <= 4096 and n <= MOST_ENTRIES:
        for k in range(n):
            e = source.read(512 * at + k * size, 48)
            if len(e) < 48:
                break
            first, last = struct.unpack_from("<QQ", e, 32)
            first, end = 512 * first, min(512 * (last + 1), source.size)
            if 0 < first < end:
                out += _try(source, first, end - first, depth)
    return out


def _try(source: Part, at: int, size: int, depth: int) -> list[Volume]:
    try:
        return volumes(Part(source, at, size), depth=depth + 1)
    except ValueError:
        return []


def volumes(source: Part, rsrc: bytes = b"", depth: int = 0) -> list[Volume]:
    """The volumes of a disk image, given its resource fork where it has one."""
    for kind, number, _, data in resources(rsrc):
        if kind == "bcem" and number == 128:  # before all else: the data may begin with a bare volume's sectors
            disk = Chunked(source, ndif(data, source.size))
            return volumes(Part(disk, 0, disk.size), depth=1)
    if source.size < 1536 or depth > DEEPEST:
        raise NotAnImage("too short or too deep")
    head = source.whole(0, 1536)
    tail = source.read(source.size - 512, 512)
    if tail[:4] == b"koly":
        disk = udif(source, tail)
        return volumes(Part(disk, 0, disk.size), depth=depth + 1)
    v = head[1024:]
    (block,) = struct.unpack_from(">I", v, 0x14)
    if v[:2] == b"BD" and block and block % 512 == 0:
        return [hfs(source)]
    (version,), (block,) = struct.unpack_from(">H", v, 2), struct.unpack_from(">I", v, 40)
    if v[:2] in (b"H+", b"HX") and version in (4, 5) and block >= 512 and not block & (block - 1):
        return [hfs_plus(source)]
    if head[512:514] == b"PM" or head[:2] == b"ER" and head[512:520] != b"EFI PART":
        if found := _apm(source, head, depth):
            return found
        if head[512:514] == b"PM":
            raise NoVolume("no volume in the partition map")
    if head[512:520] == b"EFI PART":
        if found := _gpt(source, head[512:], depth):
            return found
        raise NoVolume("no volume in the partition table")
    for at, size_at, plain in ((84, 64, head[0] < 64 and head[82:84] == b"\1\0"), (128, 83, head[0] == 0 == head[74] and 0 < head[1] < 64)):
        (n,) = struct.unpack_from(">I", head, size_at)
        if plain and 0 < n <= source.size - at:
            return volumes(Part(source, at, n), depth=depth + 1)
    raise NotAnImage("no disk's signature")
