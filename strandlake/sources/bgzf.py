"""BGZF: blocked gzip. Codec on bytes, and a sink that writes one part per task."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

# Largest payload of a block; the empty block that ends a file.
MAX_PAYLOAD = 0xFF00
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


class InvalidBgzf(ValueError):
    pass


def block_size(data, at: int) -> tuple[int, int]:
    """(bytes of the block at a position, where its deflate stream begins)."""
    if len(data) - at < 18 or data[at : at + 4] != b"\x1f\x8b\x08\x04":
        raise InvalidBgzf(f"no block at byte {at}")
    extra = int.from_bytes(data[at + 10 : at + 12], "little")
    field, end = at + 12, at + 12 + extra
    while field + 4 <= end:
        size = int.from_bytes(data[field + 2 : field + 4], "little")
        if data[field : field + 2] == b"BC" and size == 2:
            total = int.from_bytes(data[field + 4 : field + 6], "little") + 1
            if at + total > len(data):
                raise InvalidBgzf(f"the block at byte {at} is cut off")
            return total, end
        field += 4 + size
    raise InvalidBgzf(f"the block at byte {at} has no size field")


def blocks(data) -> Iterator[bytes]:
    """Payloads in order. Checksums are not tested and no end block is needed."""
    at = 0
    while at < len(data):
        size, begin = block_size(data, at)
        try:
            yield zlib.decompress(data[begin : at + size - 8], -15)
        except zlib.error as e:
            raise InvalidBgzf(f"the block at byte {at}: {e}") from e
        at += size


def inflate(data) -> bytes:
    return b"".join(blocks(data))


def block(payload: bytes) -> bytes:
    if len(payload) > MAX_PAYLOAD:
        raise ValueError("payload of a block is too long")
    c = zlib.compressobj(-1, zlib.DEFLATED, -15)
    body = c.compress(payload) + c.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def deflate(data: bytes, end: bool = True) -> bytes:
    """Blocks of the data; with the end block a whole file."""
    out = [block(data[a : a + MAX_PAYLOAD]) for a in range(0, len(data), MAX_PAYLOAD)]
    return b"".join(out) + EOF_BLOCK * end
