"""Frames around payloads: what is read is checked to be what was written.

A frame is a fixed header (magic, checksum of the body, number of values, length of the body) and the body. A wrong magic, a wrong name,
a cut or lengthened body and changed bytes raise ``Malformed``, before any decoder sees them.
"""

from __future__ import annotations

import struct
import zlib

MAGIC = b"cln1"
HEADER = struct.Struct("<4sIIQ")


class Malformed(ValueError):
    """Bytes that are no whole section."""


def frame(section: str, n: int, body: bytes) -> bytes:
    return HEADER.pack(MAGIC, zlib.crc32(body, zlib.crc32(section.encode())), n, len(body)) + body


def unframe(section: str, n: int, data: bytes) -> bytes:
    """The body of a frame of n values under a section's name."""
    if len(data) < HEADER.size:
        raise Malformed(f"{section}: {len(data)} bytes are no frame")
    magic, check, count, size = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise Malformed(f"{section}: wrong magic {magic!r}")
    if len(data) != HEADER.size + size:
        raise Malformed(f"{section}: {len(data) - HEADER.size} bytes where {size} were written")
    if count != n:
        raise Malformed(f"{section}: {count} values where {n} are expected")
    body = data[HEADER.size :]
    if zlib.crc32(body, zlib.crc32(section.encode())) != check:
        raise Malformed(f"{section}: changed bytes, or another section")
    return body
