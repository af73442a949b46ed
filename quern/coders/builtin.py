"""The coders that come with the library, all on whole arrays in numpy."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
import zstandard

from quern.coders.base import DTYPES, Coder, Factory, is_float, is_int
from quern.errors import CoderError, CorruptedError, ParameterError, PipelineError


def _ints(coder: str, t: str) -> np.dtype:
    if not is_int(t):
        raise PipelineError(f"{coder!r} takes whole numbers, not {t}")
    return DTYPES[t]


def _unsigned(d: np.dtype) -> np.dtype:
    return np.dtype(f"u{d.itemsize}")


# -- bytes of numbers


def varints(x: np.ndarray) -> bytes:
    """LEB128 of unsigned numbers, seven bits to a byte, least first."""
    x = x.astype(np.uint64)
    if not len(x):
        return b""
    size = np.ones(len(x), np.int64)
    for i in range(1, 10):
        size += x >= np.uint64(1) << np.uint64(7 * i)
    out = np.empty(int(size.sum()), np.uint8)
    first = np.cumsum(size) - size
    for i in range(int(size.max())):
        has = size > i
        byte = (x[has] >> np.uint64(7 * i)) & np.uint64(0x7F)
        out[first[has] + i] = byte | np.where(size[has] > i + 1, 0x80, 0).astype(np.uint64)
    return out.tobytes()


def from_varints(data: bytes, coder: str = "leb128") -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(b < 0x80)
    if not len(ends) or ends[-1] != len(b) - 1:
        raise CorruptedError(coder, "the last number is cut off")
    first = np.r_[0, ends[:-1] + 1]
    size = ends - first + 1
    if size.max() > 10 or (size.max() == 10 and (b[ends[size == 10]] > 1).any()):
        raise CorruptedError(coder, "a number has over 64 bits")
    out = np.zeros(len(ends), np.uint64)
    for i in range(int(size.max())):
        has = size > i
        out[has] |= (b[first[has] + i] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * i)
    return out


def packed(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each number, least bit first, without gaps."""
    if not width or not len(x):
        return b""
    bits = (x.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, n: int, width: int, coder: str) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    if len(data) < (n * width + 7) // 8:
        raise CorruptedError(coder, "too few bytes")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


# -- differences


def _delta(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    u = out.view(_unsigned(x.dtype))
    u[1:] -= x.view(u.dtype)[:-1]
    return out


def _undelta(x: np.ndarray) -> np.ndarray:
    u = x.view(_unsigned(x.dtype))
    return np.cumsum(u, dtype=u.dtype).view(x.dtype)


def delta(params: dict, t: str) -> Coder:
    _ints("delta", t)
    return Coder("delta", t, t, False, _delta, _undelta)


def delta_of_delta(params: dict, t: str) -> Coder:
    _ints("delta_of_delta", t)
    return Coder("delta_of_delta", t, t, False, lambda x: _delta(_delta(x)), lambda x: _undelta(_undelta(x)))


def deltamin(params: dict, t: str) -> Coder:
    d = _ints("deltamin", t)
    u = _unsigned(d)

    def encode(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x[:0], [x.min()], (x.view(u) - x.min().view(u)).view(d))).astype(d) if len(x) else x

    def decode(x: np.ndarray) -> np.ndarray:
        return (x[1:].view(u) + x[0].view(u)).view(d) if len(x) else x

    return Coder("deltamin", t, t, True, encode, decode)


def rle(params: dict, t: str) -> Coder:
    d = _ints("rle", t)
    most = min(int(np.iinfo(d).max), 1 << 62)

    def encode(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return x
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        count = np.diff(np.r_[first, len(x)])
        parts = -(-count // most)  # runs that the type can't count are split
        value, left = np.repeat(x[first], parts), np.full(int(parts.sum()), most, np.int64)
        last = np.cumsum(parts) - 1
        left[last] = count - (parts - 1) * most
        return np.stack((value, left.astype(d)), 1).ravel()

    def decode(x: np.ndarray) -> np.ndarray:
        if len(x) % 2:
            raise CorruptedError("rle", "a value has no count")
        if (x[1::2] <= 0).any():
            raise CorruptedError("rle", "a count isn't positive")
        return np.repeat(x[::2], x[1::2].astype(np.int64))

    return Coder("rle", t, t, False, encode, decode)


# -- to bytes


def leb128(params: dict, t: str) -> Coder:
    d = _ints("leb128", t)
    u, bits = _unsigned(d), np.array(d.itemsize * 8 - 1, d)

    def encode(x: np.ndarray) -> bytes:
        return varints(((x << np.array(1, d)) ^ (x >> bits)).view(u) if d.kind == "i" else x)

    def decode(data: bytes) -> np.ndarray:
        x = from_varints(data)
        if len(x) and x.max() > np.iinfo(u).max:
            raise CorruptedError("leb128", f"a number exceeds {t}")
        x = x.astype(u)
        if d.kind == "u":
            return x
        return (x >> np.array(1, u)).view(d) ^ -((x & np.array(1, u)).view(d))

    return Coder("leb128", t, "bytes", False, encode, decode)


def _fits(coder: str, x: np.ndarray, width: int) -> None:
    if len(x) and (x.min() < 0 or int(x.max()) >= 1 << width):
        raise CoderError(coder, f"a value is negative or needs over {width} bits")


def bitpack_fixed(params: dict, t: str) -> Coder:
    d = _ints("bitpack_fixed", t)
    width = params.get("width")
    if not isinstance(width, int) or not 1 <= width <= d.itemsize * 8:
        raise ParameterError("bitpack_fixed", "width", f"1 to {d.itemsize * 8} is needed, not {width!r}")

    def encode(x: np.ndarray) -> bytes:
        _fits("bitpack_fixed", x, width)
        return len(x).to_bytes(8, "little") + packed(x, width)

    def decode(data: bytes) -> np.ndarray:
        if len(data) < 8:
            raise CorruptedError("bitpack_fixed", "no count")
        return unpacked(data[8:], int.from_bytes(data[:8], "little"), width, "bitpack_fixed").astype(d)

    return Coder("bitpack_fixed", t, "bytes", False, encode, decode, random_access=True)


def bitpack_auto(params: dict, t: str) -> Coder:
    d = _ints("bitpack_auto", t)

    def encode(x: np.ndarray) -> bytes:
        width = int(x.max()).bit_length() if len(x) else 0
        _fits("bitpack_auto", x, max(width, 1))
        return bytes([width]) + len(x).to_bytes(8, "little") + packed(x, width)

    def decode(data: bytes) -> np.ndarray:
        if len(data) < 9 or data[0] > 64:
            raise CorruptedError("bitpack_auto", "no valid head")
        return unpacked(data[9:], int.from_bytes(data[1:9], "little"), data[0], "bitpack_auto").astype(d)

    return Coder("bitpack_auto", t, "bytes", True, encode, decode, random_access=True)


def elias_fano(params: dict, t: str) -> Coder:
    if t not in ("u32", "u64"):
        raise PipelineError(f"'elias_fano' takes u32 or u64, not {t}")
    d = DTYPES[t]

    def encode(x: np.ndarray) -> bytes:
        if not len(x):
            return (0).to_bytes(8, "little")
        if (x[1:] <= x[:-1]).any():
            raise CoderError("elias_fano", "values must increase strictly")
        n, top = len(x), int(x[-1])
        low = max(0, (top // n).bit_length() - 1) if top // n else 0
        high = (x.astype(np.uint64) >> np.uint64(low)).astype(np.int64)
        bits = np.zeros(int(high[-1]) + n + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        return n.to_bytes(8, "little") + bytes([low]) + packed(x.astype(np.uint64) & np.uint64((1 << low) - 1), low) + np.packbits(bits, bitorder="little").tobytes()

    def decode(data: bytes) -> np.ndarray:
        if len(data) < 8:
            raise CorruptedError("elias_fano", "no count")
        n = int.from_bytes(data[:8], "little")
        if not n:
            return np.zeros(0, d)
        low, size = data[8], (n * data[8] + 7) // 8
        lows = unpacked(data[9 : 9 + size], n, low, "elias_fano")
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(data[9 + size :], np.uint8), bitorder="little"))
        if len(ones) != n:
            raise CorruptedError("elias_fano", f"{len(ones)} values where {n} are named")
        return ((ones - np.arange(n)).astype(np.uint64) << np.uint64(low) | lows).astype(d)

    return Coder("elias_fano", t, "bytes", True, encode, decode, random_access=True)


_GROUP = 64


def gorilla(params: dict, t: str) -> Coder:
    """XOR with the value before; each group of 64 keeps the bits that any of its XORs uses, a flag per zero XOR."""
    if not is_float(t):
        raise PipelineError(f"'gorilla' takes floats, not {t}")
    d = DTYPES[t]
    u, bits = _unsigned(d), d.itemsize * 8

    def encode(x: np.ndarray) -> bytes:
        raw = x.view(u)
        xor = raw.copy()
        xor[1:] ^= raw[:-1]
        out = [len(x).to_bytes(8, "little")]
        for at in range(0, len(xor), _GROUP):
            g = xor[at : at + _GROUP].astype(np.uint64)
            some = g != 0
            every = int(np.bitwise_or.reduce(g))
            low = (every & -every).bit_length() - 1 if every else 0
            width = every.bit_length() - low if every else 0
            out.append(bytes([low, width]) + np.packbits(some, bitorder="little").tobytes() + packed(g[some] >> np.uint64(low), width))
        return b"".join(out)

    def decode(data: bytes) -> np.ndarray:
        if len(data) < 8:
            raise CorruptedError("gorilla", "no count")
        n, at = int.from_bytes(data[:8], "little"), 8
        if n > (len(data) - 8) * _GROUP:
            raise CorruptedError("gorilla", "too few bytes")
        xor = np.zeros(n, np.uint64)
        for first in range(0, n, _GROUP):
            m = min(_GROUP, n - first)
            flags = (m + 7) // 8
            if len(data) < at + 2 + flags or data[at] + data[at + 1] > bits:
                raise CorruptedError("gorilla", "no valid group head")
            low, width = data[at], data[at + 1]
            some = np.unpackbits(np.frombuffer(data[at + 2 : at + 2 + flags], np.uint8), count=m, bitorder="little").astype(bool)
            at += 2 + flags
            size = (int(some.sum()) * width + 7) // 8
            xor[first : first + m][some] = unpacked(data[at : at + size], int(some.sum()), width, "gorilla") << np.uint64(low)
            at += size
        return np.bitwise_xor.accumulate(xor).astype(u).view(d)

    return Coder("gorilla", t, "bytes", False, encode, decode)


def for_bitpack_zstd(params: dict, t: str) -> Coder:
    """Typed numbers of any kind: differences or distances from the least value, whichever is narrower, bytes
    transposed and compressed by zstd."""
    if not (is_int(t) or is_float(t)):
        raise PipelineError(f"'for_bitpack_zstd' takes numbers, not {t}")
    d = DTYPES[t]
    u = _unsigned(d)
    level = _level("for_bitpack_zstd", params, 3)

    def encode(x: np.ndarray) -> bytes:
        raw = x.view(u)
        plain = raw - raw.min() if len(raw) and d.kind == "u" else ((x.view(d) if d.kind == "i" else raw.view(f"i{d.itemsize}")).view(u))
        if d.kind == "i" and len(raw):
            plain = raw - x.min().view(u)
        base = (x.min().view(u) if d.kind in "iu" and len(raw) else np.zeros(1, u)[0]).tobytes()
        steps = _delta(raw)
        signed = steps.view(f"i{d.itemsize}")
        zigzag = (steps << np.array(1, u)) ^ (signed >> np.array(d.itemsize * 8 - 1, signed.dtype)).view(u)
        found = []
        for mode, v in ((0, plain), (1, zigzag)):
            planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, d.itemsize).T) if len(v) else b""
            found.append(bytes([mode]) + base + zstandard.ZstdCompressor(level=level).compress(bytes(planes)))
        return len(x).to_bytes(8, "little") + min(found, key=len)

    def decode(data: bytes) -> np.ndarray:
        if len(data) < 9 + d.itemsize or data[8] > 1:
            raise CorruptedError("for_bitpack_zstd", "no valid head")
        n, base = int.from_bytes(data[:8], "little"), np.frombuffer(data[9 : 9 + d.itemsize], u)[0]
        planes = _unzstd("for_bitpack_zstd", data[9 + d.itemsize :])
        if len(planes) != n * d.itemsize:
            raise CorruptedError("for_bitpack_zstd", "another count of values")
        v = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(d.itemsize, n).T).view(u).ravel() if n else np.zeros(0, u)
        if data[8] == 0:
            return (v + base if d.kind in "iu" else v).view(d)
        one = np.array(1, u)
        return _undelta((v >> one) ^ (np.zeros(1, u)[0] - (v & one))).view(d)

    return Coder("for_bitpack_zstd", t, "bytes", True, encode, decode)


# -- bytes to bytes


def _level(coder: str, params: dict, default: int) -> int:
    level = params.get("level", default)
    if not isinstance(level, int) or not -7 <= level <= 22:
        raise ParameterError(coder, "level", f"-7 to 22 is needed, not {level!r}")
    return level


def _unzstd(coder: str, data: bytes) -> bytes:
    try:
        return zstandard.ZstdDecompressor().decompress(data)
    except zstandard.ZstdError as e:
        raise CorruptedError(coder, str(e)) from e


def _bytes(coder: str, t: str) -> None:
    if t != "bytes":
        raise PipelineError(f"{coder!r} takes bytes, not {t}")


def zstd(params: dict, t: str) -> Coder:
    _bytes("zstd", t)
    level = _level("zstd", params, 3)
    return Coder("zstd", "bytes", "bytes", True, lambda b: zstandard.ZstdCompressor(level=level).compress(b), lambda b: _unzstd("zstd", b))


def _arrow(coder: str, name: str) -> Factory:
    def factory(params: dict, t: str) -> Coder:
        _bytes(coder, t)
        codec = pa.Codec(name)

        def decode(b: bytes) -> bytes:
            if len(b) < 8:
                raise CorruptedError(coder, "no size")
            size = int.from_bytes(b[:8], "little")
            if size > 256 * max(len(b), 1) + 64:
                raise CorruptedError(coder, "impossible size")
            try:
                return codec.decompress(b[8:], size).to_pybytes() if size else b""
            except (pa.ArrowInvalid, OSError) as e:
                raise CorruptedError(coder, str(e)) from e

        return Coder(coder, "bytes", "bytes", True, lambda b: len(b).to_bytes(8, "little") + (codec.compress(b, asbytes=True) if b else b""), decode)

    return factory


BUILTIN: dict[str, Any] = {
    "bitpack_auto": bitpack_auto,
    "bitpack_fixed": bitpack_fixed,
    "delta": delta,
    "delta_of_delta": delta_of_delta,
    "deltamin": deltamin,
    "elias_fano": elias_fano,
    "for_bitpack_zstd": for_bitpack_zstd,
    "gorilla": gorilla,
    "leb128": leb128,
    "lz4": _arrow("lz4", "lz4_raw"),
    "rle": rle,
    "snappy": _arrow("snappy", "snappy"),
    "zstd": zstd,
}
