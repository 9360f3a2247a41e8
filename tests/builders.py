"""Small files of every kind that the decoders read, made byte by byte."""

from __future__ import annotations

import base64
import struct
import zlib

from palimpsest.functions.forks import _HQX


def resource_fork(rows: list[tuple[bytes, int, str, bytes]]) -> bytes:
    data, refs, names, types = b"", {}, b"", []
    for kind, number, name, body in rows:
        at = -1
        if name:
            at = len(names)
            names += bytes([len(name)]) + name.encode("mac_roman")
        refs.setdefault(kind, []).append(struct.pack(">hhII", number, at, len(data), 0))
        data += struct.pack(">I", len(body)) + body
        types += [kind] * (kind not in types)
    table, lists = b"", b""
    for kind in types:
        table += struct.pack(">4sHH", kind, len(refs[kind]) - 1, 2 + 8 * len(types) + len(lists))
        lists += b"".join(refs[kind])
    listed = struct.pack(">h", len(types) - 1) + table + lists
    head = bytes(24) + struct.pack(">HH", 28, 28 + len(listed)) + listed + names
    return struct.pack(">IIII", 256, 256 + len(data), len(data), len(head)) + bytes(240) + data + head


def mac_binary(name: str, kind: bytes, data: bytes, rsrc: bytes) -> bytes:
    head = bytearray(128)
    head[1 : 2 + len(name)] = bytes([len(name)]) + name.encode()
    head[65:73] = kind
    struct.pack_into(">II", head, 83, len(data), len(rsrc))
    return bytes(head) + data + bytes(-len(data) % 128) + rsrc + bytes(-len(rsrc) % 128)


def apple_double(rsrc: bytes, kind: bytes = b"osasToyS", data: bytes | None = None) -> bytes:
    parts = [(9, kind + bytes(24)), (2, rsrc)] + ([(1, data)] if data is not None else [])
    at, table, body = 26 + 12 * len(parts), b"", b""
    for n, b in parts:
        table += struct.pack(">III", n, at + len(body), len(b))
        body += b
    return struct.pack(">II16xH", 0x51607 if data is None else 0x51600, 0x20000, len(parts)) + table + body


def bin_hex(name: str, kind: bytes, data: bytes, rsrc: bytes) -> bytes:
    raw = bytes([len(name)]) + name.encode() + b"\0" + kind + b"\0\0" + struct.pack(">II", len(data), len(rsrc)) + b"\0\0" + data + b"\0\0" + rsrc + b"\0\0"
    packed, k = bytearray(), 0
    while k < len(raw):
        n = 1
        while n < 255 and raw[k : k + 1] * (n + 1) == raw[k : k + n + 1]:
            n += 1
        packed += b"\x90\0" * n if raw[k] == 0x90 else bytes([raw[k], 0x90, n]) if n > 3 else raw[k : k + n]
        k += n
    bits = "".join(f"{b:08b}" for b in packed)
    bits += "0" * (-len(bits) % 6)
    text = bytes(_HQX[int(bits[k : k + 6], 2)] for k in range(0, len(bits), 6))
    lines = b"\n".join(text[k : k + 64] for k in range(0, len(text), 64))
    return b"junk\n(This file must be converted with BinHex 4.0)\n\n:" + lines + b":\n"


def refs(typ: int, ref: int, to: list[int], kind: int | None = None) -> bytes:
    return struct.pack(">BhH", typ, ref, len(to)) + (bytes([kind]) if kind is not None else b"") + struct.pack(f">{len(to)}h", *to)


def raw(typ: int, ref: int, data: bytes, kind: int | None = None) -> bytes:
    return struct.pack(">BhH", typ, ref, len(data)) + (bytes([kind]) if kind is not None else b"") + data


def number(ref: int, value: int) -> bytes:
    return struct.pack(">Bhh", 3, ref, value)


def word(ref: int, *spelt: str) -> bytes:
    return raw(0x0B, ref, b"".join(struct.pack(">H", len(s)) + s.encode() for s in spelt), 0x30)


def compiled(code: bytes = bytes([0xA0, 0xE0, 0x1E, 0x0F])) -> bytes:
    """A script of one handler, add(x), whose code adds its first literal to x and returns; a node that nothing refers to."""
    body = b"".join([
        refs(0x0E, 0, [1, 1, 2], 15), raw(0x01, 1, b""), refs(0x10, 2, [1, 1, 3]), refs(0x0E, 3, [4, 1, 5, 1, 6, 7, 8], 16), word(4, "add", "Add"),
        refs(0x0E, 5, [9, 10], 4), number(9, 1), refs(0x0E, 10, [11], 0), word(11, "x"), refs(0x10, 6, [11]), refs(0x10, 7, [12, 13, 15]), number(12, -2),
        refs(0x0E, 13, [14], 0xB1), raw(0x11, 14, 'a "b"'.encode("utf-16-be")), raw(0x08, 15, struct.pack(">d", 12345.678)), raw(0x11, 8, code),
        struct.pack(">BhHBHHHhh", 0x0D, 20, 2, ord("k"), 1, 2, 3, 21, -1), struct.pack(">BhHBHHH", 0x0D, 21, 0, ord("o"), 0, 0, 0),
    ])
    return b"FasdUAS 1.101.10" + body + b"ascr\0\1\0\x0c\xfa\xde\xde\xad"


def block(kind: bytes, ident: int, body: bytes, order: str = ">") -> bytes:
    body += bytes(-(16 + len(body)) % 32)  # blocks start at multiples of 32
    return struct.pack(order + "I4si", 16 + len(body), kind, ident) + bytes(4) + body


def layer(parts: list[tuple[int, int, str, str]], texts: list[tuple[int, bytes]], name: str, script: str) -> bytes:
    made = b""
    for ident, kind, own, source in parts:
        p = bytearray(30)
        struct.pack_into(">HHB", p, 0, 0, ident, kind)
        p += own.encode("mac_roman") + b"\0\0" + source.replace("\n", "\r").encode("mac_roman") + b"\0"
        p += bytes(len(p) % 2)
        struct.pack_into(">H", p, 0, len(p))
        made += p
    held = b"".join(struct.pack(">hH", i, len(t)) + t + bytes(len(t) % 2) for i, t in texts)
    return struct.pack(">HHIHI", len(parts), 9, len(made), len(texts), len(held)) + made + held + name.encode("mac_roman") + b"\0" + script.replace("\n", "\r").encode("mac_roman") + b"\0"


def stack(damage: bytes = b"") -> bytes:
    head = bytearray(0x600 - 16)
    for at, v in ((0, 10), (24, 7), (28, 2), (36, 5)):
        struct.pack_into(">I", head, at, v)
    pages = struct.pack(">I8xHxx", 1, 8).ljust(32, b"\0") + struct.pack(">IH", 6, 2)
    back = bytearray(20)
    struct.pack_into(">I", back, 12, 7)
    link = bytearray(24)
    struct.pack_into(">I", link, 20, 7)
    return b"".join([
        block(b"STAK", -1, bytes(head) + b"on openStack\rput 1\rend openStack\0"), damage, block(b"LIST", 5, pages), block(b"PAGE", 6, bytes(8) + struct.pack(">I4xI4x", 12, 11)),
        block(b"BKGD", 7, bytes(back) + layer([(1, 2, "Notes", ""), (2, 1, "Go", "on mouseUp\nif x then\nbeep\nelse\ngo next\nend if\nend mouseUp")], [], "Back", "")),
        block(b"CARD", 11, bytes(link) + layer([], [(1, b"\0caf\x8e \x11"), (2, b"\0" + b"1")], "Home", "")),
        block(b"CARD", 12, bytes(link) + layer([(3, 2, "", "")], [(-3, b"\x80\x06\0\0\0\1own")], "", "on idle\nend idle")), block(b"TAIL", -1, b""),
    ])


B = 512


class Disk:
    """A volume of blocks of 512 bytes; forks are cut into extents of one block each."""

    def __init__(self, plus: bool):
        self.plus, self.first = plus, 0 if plus else 3
        self.blocks: list[bytes] = [bytes(B)] * (3 if plus else 0)
        self.catalog: list[bytes] = []
        self.extents: list[bytes] = []

    def put(self, data: bytes, scatter: bool = True) -> list[tuple[int, int]]:
        out = []
        for k in range(0, len(data), B):
            self.blocks.append(data[k : k + B].ljust(B, b"\0"))
            out.append((len(self.blocks) - 1, 1))
            if scatter:
                self.blocks.append(b"\xee" * B)
        return out if scatter else [(out[0][0], len(out))] if out else []

    def pack(self, ext: list[tuple[int, int]]) -> bytes:
        return b"".join(struct.pack(">II" if self.plus else ">HH", *e) for e in ext).ljust(64 if self.plus else 12, b"\0")

    def fork(self, ident: int, is_rsrc: bool, data: bytes) -> tuple[int, bytes]:
        ext, n = self.put(data), 8 if self.plus else 3
        for k in range(n, len(ext), n):
            key = struct.pack(">HBxII", 10, 0xFF * is_rsrc, ident, k) if self.plus else struct.pack(">BBIH", 7, 0xFF * is_rsrc, ident, k)
            self.extents.append(key + self.pack(ext[k : k + n]))
        return len(data), self.pack(ext[:n])

    def key(self, parent: int, name: str) -> bytes:
        if self.plus:
            return struct.pack(">HIH", 6 + 2 * len(name), parent, len(name)) + name.encode("utf-16-be")
        k = struct.pack(">BxIB", 6 + len(name), parent, len(name)) + name.encode("mac_roman")
        return k + bytes(len(k) % 2)

    def folder(self, parent: int, ident: int, name: str) -> None:
        self.catalog.append(self.key(parent, name) + (struct.pack(">HHII", 1, 0, 0, ident) if self.plus else struct.pack(">BBHHI", 1, 0, 0, 0, ident)).ljust(88, b"\0"))

    def file(self, parent: int, ident: int, name: str, data: bytes, rsrc: bytes = b"") -> None:
        (n, d), (m, r) = self.fork(ident, False, data), self.fork(ident, True, rsrc)
        e = bytearray(248 if self.plus else 102)
        if self.plus:
            struct.pack_into(">H6xI", e, 0, 2, ident)
            e[48:56] = b"TEXTttxt"
            struct.pack_into(">Q", e, 88, n)
            e[104:168] = d
            struct.pack_into(">Q", e, 168, m)
            e[184:248] = r
        else:
            e[0], e[4:12] = 2, b"TEXTttxt"
            for at, v in ((20, ident), (26, n), (36, m)):
                struct.pack_into(">I", e, at, v)
            e[74:86], e[86:98] = d, r
        self.catalog.append(self.key(parent, name) + bytes(e))

    @staticmethod
    def tree(records: list[bytes]) -> bytes:
        leaves: list[list[bytes]] = [[]]
        for r in records:
            if sum(map(len, leaves[-1])) + len(r) + 2 * len(leaves[-1]) > B - 24:
                leaves.append([])
            leaves[-1].append(r)
        head = bytearray(B)
        struct.pack_into(">IxxH", head, 24, 1, 0)
        struct.pack_into(">H", head, 32, B)
        out = bytes(head)
        for k, rows in enumerate(leaves):
            node = bytearray(B)
            struct.pack_into(">IIbBH", node, 0, k + 2 if k + 1 < len(leaves) else 0, 0, -1, 1, len(rows))
            at = 14
            for j, r in enumerate([*rows, b""]):
                struct.pack_into(">H", node, B - 2 * (j + 1), at)
                node[at : at + len(r)] = r
                at += len(r)
            out += bytes(node)
        return out

    def image(self) -> bytes:
        trees = [self.tree(self.extents), self.tree(self.catalog)]
        placed = [self.put(t, scatter=False) for t in trees]
        if self.plus:
            head = bytearray(B)
            head[:4] = b"H+\0\4"
            struct.pack_into(">I", head, 40, B)
            for at, t, e in zip((192, 272), trees, placed):
                struct.pack_into(">Q8xII", head, at, len(t), *e[0])
            self.blocks[2] = bytes(head)
            return b"".join(self.blocks)
        head = bytearray(B)
        head[:2] = b"BD"
        struct.pack_into(">I4xH", head, 0x14, B, self.first)
        head[0x24:0x29] = b"\4Disk"
        for at, t, e in zip((0x82, 0x92), trees, placed):
            struct.pack_into(">IHH", head, at, len(t), *e[0])
        return bytes(2 * B) + bytes(head) + b"".join(self.blocks)


def disk(plus: bool, files: list[tuple[str, bytes, bytes]]) -> bytes:
    d = Disk(plus)
    d.folder(1, 2, "Disk")
    d.folder(2, 16, "Sub")
    for k, (name, data, rsrc) in enumerate(files):
        d.file(16 if k % 2 else 2, 20 + k, name, data, rsrc)
    return d.image()


def apm(volume: bytes) -> bytes:
    volume += bytes(-len(volume) % B)
    entry = lambda n, first, count, kind: struct.pack(">2sxxIII32s32s", b"PM", n, first, count, b"", kind).ljust(B, b"\0")
    return b"ER".ljust(B, b"\0") + entry(2, 1, 2, b"Apple_partition_map") + entry(2, 3, len(volume) // B, b"Apple_HFS") + volume


def gpt(volume: bytes) -> bytes:
    volume += bytes(-len(volume) % B)
    head = bytearray(B)
    head[:8] = b"EFI PART"
    struct.pack_into("<QII", head, 72, 2, 1, 128)
    e = bytearray(B)
    struct.pack_into("<QQ", e, 32, 3, 2 + len(volume) // B)
    return bytes(B) + bytes(head) + bytes(e) + volume


def udif(volume: bytes) -> bytes:
    volume += bytes(-len(volume) % B)
    n, half = len(volume) // B, len(volume) // B // 2
    parts = [(0x80000005, 0, half, zlib.compress(volume[: half * B])), (1, half, n - half, volume[half * B :]), (0xFFFFFFFF, n, 0, b"")]
    table, body = bytearray(b"mish".ljust(204, b"\0")), b""
    struct.pack_into(">I", table, 200, len(parts))
    for how, first, count, data in parts:
        table += struct.pack(">IIQQQQ", how, 0, first, count, len(body), len(data))
        body += data
    xml = b"<plist><data>\n" + base64.encodebytes(bytes(table)) + b"</data></plist>"
    tail = bytearray(B)
    tail[:4] = b"koly"
    struct.pack_into(">QQ", tail, 216, len(body), len(xml))
    return body + xml + bytes(tail)


def ndif(volume: bytes) -> tuple[bytes, bytes]:
    volume += bytes(-len(volume) % B)
    n, half = len(volume) // B, len(volume) // B // 2
    packed = b"".join(bytes([0x80 | len(p) - 1]) + p for k in range(0, half * B, 128) if (p := volume[k : min(k + 128, half * B)]))
    rows = [(0, 0x83, 0, len(packed)), (half, 2, len(packed), (n - half) * B), (n, 0xFF, 0, 0)]
    layout = bytearray(0x80)
    struct.pack_into(">I", layout, 0x44, n)
    struct.pack_into(">I", layout, 0x7C, len(rows))
    for first, how, at, size in rows:
        layout += struct.pack(">I", first << 8 | how) + struct.pack(">II", at, size)
    return packed + volume[half * B :], resource_fork([(b"bcem", 128, "", bytes(layout))])
