"""Compound files (the container of older office formats): streams by name, read under bounds.

A file of sectors: a header names the sectors of the allocation table, the table chains sectors to streams, and a
directory (a stream too) holds a tree of names. Small streams lie in a stream of their own, in small sectors. Every
chain is followed once at most over the sectors that there are, so a damaged file cannot make reading go on.
"""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


class Compound:
    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC or len(raw) < 512:
            raise ValueError("no compound file")
        self.raw = raw
        sector, small = struct.unpack_from("<HH", raw, 30)
        if not 7 <= sector <= 16 or not 4 <= small <= sector:
            raise ValueError("damaged header")
        self.size, self.small_size = 1 << sector, 1 << small
        n_fat, directory, _, self.cutoff, small_fat, n_small, more, n_more = struct.unpack_from("<I I I I I I I I", raw, 44)
        tables = list(struct.unpack_from("<109I", raw, 76))
        last = len(raw) // self.size + 1
        for _ in range(min(n_more, last)):
            if more >= END:
                break
            part = self.sector(more)
            *found, more = struct.unpack(f"<{len(part) // 4}I", part)
            tables += found
        self.table: list[int] = []
        for k in tables[: min(n_fat, last)]:
            if k < END:
                part = self.sector(k)
                self.table += struct.unpack(f"<{len(part) // 4}I", part)
        rows = self.chain(directory)
        #: (name, kind, start, size, left, right, child): kind 1 is a folder, 2 a stream, 5 the root.
        self.entries = []
        for at in range(0, len(rows) - 127, 128):
            length, kind = struct.unpack_from("<HB", rows, at + 64)
            left, right, child = struct.unpack_from("<III", rows, at + 68)
            start, size = struct.unpack_from("<IQ", rows, at + 116)
            self.entries.append((rows[at : at + max(0, min(64, length) - 2)].decode("utf-16le", "replace"), kind, start, size if sector > 9 else size & 0xFFFFFFFF, left, right, child))
        if not self.entries or self.entries[0][1] != 5:
            raise ValueError("no directory")
        raw_small = self.chain(small_fat) if n_small and small_fat < END else b""
        self.small_table = struct.unpack(f"<{len(raw_small) // 4}I", raw_small[: len(raw_small) // 4 * 4])
        self.small = self.chain(self.entries[0][2])[: self.entries[0][3]] if self.entries[0][2] < END else b""

    def sector(self, k: int) -> bytes:
        return self.raw[(k + 1) * self.size : (k + 2) * self.size]

    def chain(self, start: int) -> bytes:
        out, k = [], start
        for _ in range(len(self.table)):
            if k >= END or k >= len(self.table):
                break
            out.append(self.sector(k))
            k = self.table[k]
        return b"".join(out)

    def content(self, entry: int) -> bytes:
        _, _, start, size, *_ = self.entries[entry]
        if size >= self.cutoff:
            return self.chain(start)[:size]
        out, k = [], start
        for _ in range(len(self.small_table)):
            if k >= len(self.small_table):
                break
            out.append(self.small[k * self.small_size : (k + 1) * self.small_size])
            k = self.small_table[k]
        return b"".join(out)[:size]

    def children(self, folder: int = 0) -> dict[str, int]:
        """Entries of a folder by name."""
        out, todo, met = {}, [self.entries[folder][6]], set()
        while todo:
            k = todo.pop()
            if k >= len(self.entries) or k in met:
                continue
            met.add(k)
            name, _, _, _, left, right, _ = self.entries[k]
            out[name] = k
            todo += [left, right]
        return out

    def names(self) -> set[str]:
        return set(self.children())

    def stream(self, name: str, folder: int = 0) -> bytes | None:
        k = self.children(folder).get(name)
        return self.content(k) if k is not None and self.entries[k][1] == 2 else None


def write_compound(tree: dict) -> bytes:
    """A compound file. tree: names to bytes (streams) or to trees (folders)."""
    sectors, table, small, small_table = [], [], bytearray(), []
    entries = []

    def chain(content):
        if not content:
            return END
        start, n = len(sectors), -(-len(content) // 512)
        for k in range(n):
            sectors.append(content[512 * k : 512 * k + 512].ljust(512, b"\0"))
            table.append(start + k + 1 if k + 1 < n else END)
        return start

    def small_chain(content):
        start, n = len(small_table), -(-len(content) // 64)
        small.extend(content.ljust(64 * n, b"\0"))
        small_table.extend([start + k + 1 if k + 1 < n else END for k in range(n)])
        return start if n else END

    def add(name, kind, content=b""):
        entries.append([name, kind, END, 0, FREE, FREE, FREE])
        if kind == 2:
            entries[-1][2:4] = [(small_chain if len(content) < 4096 else chain)(content), len(content)]
        return len(entries) - 1

    def fill(parent, own):
        made = []
        for name, content in own.items():
            k = add(name, 1 if isinstance(content, dict) else 2, content if isinstance(content, bytes) else b"")
            made.append(k)
            if isinstance(content, dict):
                fill(k, content)
        for a, b in zip(made, made[1:]):
            entries[a][5] = b  # a degenerate tree: each to the right of the last
        if made:
            entries[parent][6] = made[0]

    add("Root Entry", 5)
    fill(0, tree)
    entries[0][2], entries[0][3] = chain(bytes(small)), len(small)
    small_start = chain(b"".join(struct.pack("<I", x) for x in small_table))
    rows = b""
    for name, kind, start, size, left, right, child in entries:
        raw = name.encode("utf-16le") + b"\0\0"
        rows += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", left, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    directory = chain(rows)
    n = 1
    while (len(table) + n) * 4 > n * 512:
        n += 1
    first = len(sectors)
    table += [FAT] * n
    raw = b"".join(struct.pack("<I", x) for x in table).ljust(512 * n, b"\xff")
    sectors += [raw[512 * k : 512 * k + 512] for k in range(n)]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", n, directory, 0, 4096, small_start, max(1, -(-4 * len(small_table) // 512)), END, 0)
    head += b"".join(struct.pack("<I", first + k if k < n else FREE) for k in range(109))
    return head + b"".join(sectors)
