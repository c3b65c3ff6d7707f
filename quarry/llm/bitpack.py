"""Columns of numbers as few bits: ascending ones by their gaps, others by the bits that their range needs."""

from __future__ import annotations

import numpy as np


def _bits(values: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little") if width else np.zeros(0, np.uint8)
    return np.packbits(bits).tobytes()


def _values(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def rising(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers: the first, and the gaps in Rice code (the part over ``low`` bits in unary)."""
    n = len(values)
    if not n:
        return n.to_bytes(4, "little")
    gaps = np.diff(values)
    low = max(0, int(int(values[-1] - values[0]) // max(1, n - 1) * 7 // 10).bit_length() - 1)
    stops = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1)
    unary = np.zeros(int(stops[-1]) if n > 1 else 0, np.uint8)
    unary[stops - 1] = 1
    head = np.packbits(unary).tobytes()
    return b"".join([n.to_bytes(4, "little"), int(values[0]).to_bytes(8, "little"), bytes([low]), len(head).to_bytes(4, "little"), head, _bits(gaps, low)])


def read_rising(data: bytes) -> tuple[np.ndarray, bytes]:
    """The numbers, and what follows them."""
    n = int.from_bytes(data[:4], "little")
    if not n:
        return np.zeros(0, np.uint64), data[4:]
    first, low, size = int.from_bytes(data[4:12], "little"), data[12], int.from_bytes(data[13:17], "little")
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 17)))[:n - 1]
    end = 17 + size + -(-(n - 1) * low // 8)
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(low) | _values(data[17 + size:end], n - 1, low)
    out = np.full(n, first, np.uint64)
    out[1:] += np.cumsum(gaps, dtype=np.uint64)
    return out, data[end:]


def narrow(values: np.ndarray) -> bytes:
    """Signed 64-bit numbers as the least, and what each is above it."""
    if not len(values):
        return b""
    least = int(values.min())
    above = values.astype(np.int64).view(np.uint64) - np.int64(least).view(np.uint64)
    width = int(above.max()).bit_length()
    return least.to_bytes(8, "little", signed=True) + bytes([width]) + _bits(above, width)


def read_narrow(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    if not n:
        return np.zeros(0, np.int64), data
    least, width = int.from_bytes(data[:8], "little", signed=True), data[8]
    end = 9 + -(-n * width // 8)
    return (_values(data[9:end], n, width) + np.int64(least).view(np.uint64)).view(np.int64), data[end:]


def flags(values: np.ndarray) -> bytes:
    return np.packbits(values).tobytes()


def read_flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
