"""Seeded draws that any engine can repeat: eight hex digits of an MD5."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys: Column | int | str) -> Column:
    """A long in [0, 2**32) from the keys, joined by colons."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


# MD5 (RFC 1321) of many like keys in a NumPy task, where hashlib would be called for each.

Part = str | tuple[np.ndarray, int]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_LEFT = [np.array(((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4], dtype=np.uint32) for i in range(64)]
_RIGHT = [np.array(32 - int(x), dtype=np.uint32) for x in _LEFT]
_ORDER = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]


def _words(parts: list[Part]) -> list[int | np.ndarray]:
    """What MD5 reads of the keys, in words of four bytes: an int where all keys are alike."""
    found: list[int | np.ndarray] = []
    for part in parts:
        if isinstance(part, str):
            found += part.encode()
            continue
        left, size = part
        digits = []
        for _ in range(size):
            tenth = left // 10
            digits.append(left - tenth * 10 + 48)
            left = tenth
        found += digits[::-1]
    bits = 8 * len(found)
    found += [0x80, *bytes((55 - len(found)) % 64), *bits.to_bytes(8, "little")]
    return [found[i] + (found[i + 1] << 8) + (found[i + 2] << 16) + (found[i + 3] << 24) for i in range(0, len(found), 4)]


def _mixed(state: list[int] | list[np.ndarray], words: list[int | np.ndarray], shape: tuple[int, ...]) -> list[np.ndarray]:
    """The 64 steps over 16 words, in buffers that stay in a core's cache; what all keys begin with is mixed once."""
    a, b, c, d = state
    done = 0
    while done < 16 and isinstance(a, int) and isinstance(words[done], int):
        f, left = (a + (d ^ (b & (c ^ d))) + words[done] + _SINES[done]) % 2**32, int(_LEFT[done])
        a, b, c, d = d, (b + (f << left | f >> 32 - left)) % 2**32, b, c
        done += 1
    a, b, c, d = (np.full(shape, x, dtype=np.uint32) for x in (a, b, c, d))
    f = np.empty_like(a)
    for i in range(done, 64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[_ORDER[i]]
        if isinstance(word, int):
            f += np.array((word + _SINES[i]) % 2**32, dtype=np.uint32)
        else:
            f += word + np.uint32(_SINES[i])
        np.left_shift(f, _LEFT[i], out=a)
        f >>= _RIGHT[i]
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def four_draws(parts: list[Part], shape: tuple[int, ...]) -> list[np.ndarray]:
    """The four draws of 32 bits in an MD5 of each key. Keys are ``parts`` on end: texts, or numbers (uint32, that fit ``shape``) of so many digits."""
    words = _words(parts)
    state = list(_START)
    for at in range(0, len(words), 16):
        state = [x + y for x, y in zip(state, _mixed(state, words[at : at + 16], shape), strict=True)]
    return [x.byteswap() for x in state]
