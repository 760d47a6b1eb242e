"""The protobuf wire format, as far as map files need it, in whole arrays where they are packed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def signed(n: int) -> int:
    """A varint read as int64."""
    return n - (1 << 64) if n >= 1 << 63 else n


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value): varints as unsigned int, length-delimited ones as bytes."""
    at, end = 0, len(data)

    def read(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n, at
            shift += 7

    while at < end:
        key, at = read(at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = read(at)
        elif wire == 2:
            size, at = read(at)
            if at + size > end:
                raise ValueError("a field runs over its message")
            value = data[at : at + size]
            at += size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value = data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield number, wire, value


def unpack(data: bytes) -> np.ndarray:
    """Packed varints as uint64."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    last = np.flatnonzero(b < 128)
    first = np.r_[0, last[:-1] + 1]
    shift = (np.arange(last[-1] + 1) - np.repeat(first, last - first + 1)) * 7
    return np.bitwise_or.reduceat((b[: last[-1] + 1] & 127).astype(np.uint64) << shift.astype(np.uint64), first)


def unpack_signed(data: bytes) -> np.ndarray:
    """Packed zig-zag varints as int64."""
    v = unpack(data)
    return ((v >> np.uint64(1)) ^ (np.uint64(0) - (v & np.uint64(1)))).view(np.int64)


def sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each value (as uint64) as a varint."""
    v = np.asarray(values).view(np.uint64)
    out = np.ones(len(v), dtype=np.int64)
    for k in range(1, 10):
        more = v >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        out += more
    return out


def pack(values: np.ndarray) -> bytes:
    """Values (as uint64) to packed varints."""
    v = np.asarray(values).astype(np.int64).view(np.uint64)
    if not len(v):
        return b""
    size = sizes(v)
    row = np.repeat(np.arange(len(v)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = ((v[row] >> (7 * place).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    out[place < size[row] - 1] |= 128
    return out.tobytes()


def pack_signed(values: np.ndarray) -> bytes:
    v = np.asarray(values, dtype=np.int64)
    return pack((v << 1) ^ (v >> 63))


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(np.asarray(values, dtype=np.int64), prepend=np.int64(0))
