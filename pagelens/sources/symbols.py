"""Synthetic screenshots: a code of a text, drawn as modules of some pixels with a border, for the reader to find."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..operators.symbols import CHECK_WORDS, EXP, VERSIONS, alignments, block_sizes, format_bits, format_places, function_modules, masked, places, size_of, times


@lru_cache
def _multiples(checks: int) -> list[int]:
    """The product of (x - a**i) but for its first 1, times each byte: a byte for each coefficient, the highest first."""
    generator = [1]
    for i in range(checks):
        longer = [*generator, 0]
        for j, g in enumerate(generator):
            longer[j + 1] ^= times(g, EXP[i])
        generator = longer
    return [int.from_bytes(bytes(times(g, x) for g in generator[1:]), "big") for x in range(256)]


def checks_of(data: list[int], checks: int) -> list[int]:
    """The check words of a block: what is left after division by the product of (x - a**i)."""
    multiples, rest, last = _multiples(checks), 0, 8 * (checks - 1)
    for d in data:
        lead = d ^ rest >> last
        rest = (rest & (1 << last) - 1) << 8 ^ multiples[lead]
    return list(rest.to_bytes(checks, "big"))


def code_of(text: str, level: str = "M", mask: int = 0) -> np.ndarray:
    """Dark modules of the smallest code that holds a text as bytes."""
    raw = text.encode()
    for version in range(1, VERSIONS + 1):
        sizes = block_sizes(version, level)
        if 4 + (8 if version < 10 else 16) + 8 * len(raw) <= 8 * sum(sizes):
            break
    else:
        raise ValueError("the text is too long for a code")
    bits = f"{4:04b}{len(raw):0{8 if version < 10 else 16}b}" + "".join(f"{x:08b}" for x in raw)
    bits += "0" * min(4, 8 * sum(sizes) - len(bits))
    bits += "0" * (-len(bits) % 8)
    words = [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]
    words += [(0xEC, 0x11)[i % 2] for i in range(sum(sizes) - len(words))]
    blocks, at = [], 0
    for size in sizes:
        blocks.append(words[at : at + size])
        at += size
    checks = [checks_of(b, CHECK_WORDS[level][version - 1]) for b in blocks]
    stream = [b[i] for i in range(max(sizes)) for b in blocks if i < len(b)] + [c[i] for i in range(len(checks[0])) for c in checks]
    n = size_of(version)
    out = np.zeros((n, n), bool)
    for y, x in ((3, 3), (3, n - 4), (n - 4, 3)):
        _rings(out, y, x, (0, 1, 3), 4)
    out[6, 8 : n - 8] = out[8 : n - 8, 6] = np.arange(8, n - 8) % 2 == 0
    for y in alignments(version):
        for x in alignments(version):
            if (y, x) not in ((6, 6), (6, n - 7), (n - 7, 6)):
                _rings(out, y, x, (0, 2), 2)
    if version >= 7:
        rest = version
        for _ in range(12):
            rest = rest << 1 ^ (rest >> 11) * 0x1F25
        for i in range(18):
            out[i // 3, n - 11 + i % 3] = out[n - 11 + i % 3, i // 3] = (version << 12 | rest) >> i & 1
    for copy in format_places(n):
        for i, (y, x) in enumerate(copy):
            out[y, x] = format_bits(level, mask) >> i & 1
    out[n - 8, 8] = True
    y, x = places(version)
    bits = np.zeros(len(y), bool)
    bits[: 8 * len(stream)] = np.unpackbits(np.array(stream, np.uint8))
    out[y, x] = bits ^ masked(mask, y, x)
    return out


def _rings(out: np.ndarray, y: int, x: int, dark: tuple[int, ...], reach: int) -> None:
    n = len(out)
    for i in range(max(0, y - reach), min(n, y + reach + 1)):
        for j in range(max(0, x - reach), min(n, x + reach + 1)):
            out[i, j] = max(abs(i - y), abs(j - x)) in dark


def damaged(modules: np.ndarray, words: int, seed: int) -> np.ndarray:
    """modules with all bits of so many codewords turned over, spread evenly."""
    version = (len(modules) - 17) // 4
    y, x = places(version)
    n = len(y) // 8
    out = modules.copy()
    for w in range(words):
        at = (seed + w * n // max(1, words)) % n * 8 + np.arange(8)
        out[y[at], x[at]] ^= True
    return out


def drawn(modules: np.ndarray, scale: int = 3, border: int = 4, turns: int = 0, dark: int = 20, light: int = 235) -> np.ndarray:
    """Grey pixels."""
    grid = np.kron(np.pad(modules, border), np.ones((scale, scale), bool))
    return np.rot90(np.where(grid, dark, light).astype(np.uint8), turns)


__all__ = ["code_of", "damaged", "drawn", "checks_of", "function_modules"]
