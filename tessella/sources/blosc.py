"""Blosc frames (format version 2): blocks, optionally shuffled by bytes or bits, each compressed on its own.

A frame is a 16-byte header, the places of its blocks, and the blocks. A block is one stream or, where that pays, one a
byte of an element; each stream has its length before it, and one as long as its content is stored as it is.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

HEADER = struct.Struct("<BBBBIII")
BYTE_SHUFFLE, STORED, BIT_SHUFFLE, ONE_STREAM = 1, 2, 4, 16
#: Number of a compressor in a frame's flags.
FORMATS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
MOST_STREAMS, LEAST_STREAM = 16, 128


def _stream(data: bytes, kind: str, size: int) -> bytes:
    if len(data) == size:
        return data
    if kind == "zlib":
        return zlib.decompress(data)
    return pa.Codec(kind).decompress(data, size, asbytes=True)


def _unshuffled(block: np.ndarray, itemsize: int, flags: int) -> np.ndarray:
    n = len(block) // itemsize
    if flags & BYTE_SHUFFLE and itemsize > 1:
        body = block[: n * itemsize].reshape(itemsize, n).T.ravel()
        return np.concatenate([body, block[n * itemsize :]])
    if flags & BIT_SHUFFLE:
        n -= n % 8  # what is left of eight elements is not shuffled
        bits = np.unpackbits(block[: n * itemsize], bitorder="little").reshape(itemsize * 8, n).T
        return np.concatenate([np.packbits(bits.ravel(), bitorder="little"), block[n * itemsize :]])
    return block


def decode(frame: bytes) -> bytes:
    version, _, flags, itemsize, size, block_size, _ = HEADER.unpack_from(frame)
    if version != 2:
        raise ValueError(f"Blosc frames of version {version} are not read")
    if flags & STORED:
        return frame[16 : 16 + size]
    if size == 0:
        return b""
    kind = FORMATS.get(flags >> 5)
    if kind is None:
        raise ValueError("Blosc frames compressed by blosclz are not read")
    places, out = struct.unpack_from(f"<{-(-size // block_size)}I", frame, 16), []
    for i, at in enumerate(places):
        whole = min(block_size, size - i * block_size)
        split = not flags & ONE_STREAM and itemsize <= MOST_STREAMS and block_size // itemsize >= LEAST_STREAM and whole == block_size
        parts = []
        for _ in range(itemsize if split else 1):
            (length,) = struct.unpack_from("<i", frame, at)
            parts.append(_stream(frame[at + 4 : at + 4 + length], kind, whole // itemsize if split else whole))
            at += 4 + length
        out.append(_unshuffled(np.frombuffer(b"".join(parts), np.uint8), itemsize, flags).tobytes())
    return b"".join(out)


def encode(data: bytes, itemsize: int, level: int = 5) -> bytes:
    """One block of one zstd stream, shuffled by bytes."""
    n = len(data) // itemsize
    raw = np.frombuffer(data, np.uint8)
    shuffled = np.concatenate([raw[: n * itemsize].reshape(n, itemsize).T.ravel(), raw[n * itemsize :]]).tobytes()
    packed = pa.Codec("zstd", level).compress(shuffled, asbytes=True)
    if len(packed) >= len(data):
        return HEADER.pack(2, 1, STORED, itemsize, len(data), max(1, len(data)), 16 + len(data)) + data
    total = 16 + 4 + 4 + len(packed)
    return HEADER.pack(2, 1, BYTE_SHUFFLE | ONE_STREAM | 4 << 5, itemsize, len(data), len(data), total) + struct.pack("<Ii", 20, len(packed)) + packed
