"""ZIP packages that are read by ranges, without extraction: central and ZIP64 directories, stored members."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import BinaryIO

#: Signatures and limits of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
UTF8, STORED, DATE = 0x800, 0, 33  # 1980-01-01


class BadZip(ValueError):
    """The bytes are no ZIP package that can be read by ranges."""


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


class Writer:
    """Writes stored members to a stream that need not seek. zip64: write ZIP64 records even where they aren't needed."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _long(self, member: Member) -> bool:
        return self.zip64 or max(member.size, member.header) >= FULL32

    def add(self, name: str, data: bytes) -> None:
        member = Member(name, STORED, zlib.crc32(data), len(data), len(data), self.at)
        self.members.append(member)
        long, raw = self._long(member), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if long else b""
        size = FULL32 if long else len(data)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if long else 20, UTF8, STORED, 0, DATE, member.crc, size, size, len(raw), len(extra)))
        self._put(raw + extra)
        self._put(data)

    def close(self) -> None:
        start = self.at
        for m in self.members:
            long, raw = self._long(m), m.name.encode()
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.header) if long else b""
            size, header = (FULL32, FULL32) if long else (m.size, m.header)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if long else 20, UTF8, STORED, 0, DATE, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, header))
            self._put(raw + extra)
        length, n, end = self.at - start, len(self.members), self.at
        if self.zip64 or n >= FULL16 or max(length, start) >= FULL32:
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
            n, length, start = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, start, 0))


class Reader:
    """Finds members by the directory at the end; reads ranges of stored ones. file: has size(), seek() and read()."""

    def __init__(self, file):
        self.file, self.length = file, file.size()
        self.members = {m.name: m for m in self._directory()}
        self._starts: dict[str, int] = {}

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.length:
            raise BadZip(f"bytes {at} to {at + n} are outside the package of {self.length}")
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise BadZip("the package ends early")
        return data

    def _directory(self) -> list[Member]:
        tail = self.read(max(0, self.length - 22 - FULL16), min(self.length, 22 + FULL16))
        base, at = self.length - len(tail), tail.rfind(struct.pack("<I", END))
        while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise BadZip("no end of a central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if n == FULL16 or length == FULL32 or start == FULL32:
            sign, _, end64, _ = struct.unpack("<IIQI", self.read(base + at - 20, 20))
            if sign != LOCATOR64:
                raise BadZip("no ZIP64 locator")
            record = struct.unpack("<IQHHIIQQQQ", self.read(end64, 56))
            if record[0] != END64:
                raise BadZip("no ZIP64 end record")
            n, length, start = record[7:10]
        data, found, i = self.read(start, length), [], 0
        for _ in range(n):
            sign, _, _, _, method, _, _, crc, packed, size, names, extras, notes, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, i)
            if sign != CENTRAL:
                raise BadZip("the central directory is broken")
            name = data[i + 46 : i + 46 + names].decode()
            extra = data[i + 46 + names : i + 46 + names + extras]
            found.append(Member(name, method, crc, *self._wide(extra, size, packed, header)))
            i += 46 + names + extras + notes
        return found

    @staticmethod
    def _wide(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
        """(packed, size, header) with what the ZIP64 field gives for full ones."""
        i = 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:
                rest = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                size = next(rest) if size == FULL32 else size
                packed = next(rest) if packed == FULL32 else packed
                header = next(rest) if header == FULL32 else header
            i += 4 + n
        return packed, size, header

    def ranged(self, name: str, offset: int, n: int) -> bytes:
        """n bytes of a stored member from an offset."""
        m = self.members[name]
        if m.method != STORED:
            raise BadZip(f"{name} is compressed by the package; only stored members can be read by ranges")
        if offset < 0 or n < 0 or offset + n > m.size:
            raise BadZip(f"bytes {offset} to {offset + n} are outside {name}")
        if name not in self._starts:
            head = struct.unpack("<IHHHHHIIIHH", self.read(m.header, 30))
            if head[0] != LOCAL:
                raise BadZip(f"no local header of {name}")
            self._starts[name] = m.header + 30 + head[9] + head[10]
        return self.read(self._starts[name] + offset, n)

    def whole(self, name: str) -> bytes:
        data = self.ranged(name, 0, self.members[name].size)
        if zlib.crc32(data) != self.members[name].crc:
            raise BadZip(f"{name} has another checksum")
        return data
