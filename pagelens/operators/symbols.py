"""Two-dimensional codes in landed screenshots: found by their corner patterns, read and corrected.

A screenshot is a grey grid. Corner patterns are runs of dark and light in the ratio 1:1:3:1:1, along a row and a column; three
of them that form a right angle place the code, at any scale and turn. Format bits give level and mask; what they and
the fixed patterns leave are codewords, interleaved by blocks, which Reed-Solomon correction over GF(256) mends before the
segments are read. Versions up to VERSIONS are read: up to 858 bytes at the lowest level."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed values of the code's standard: levels in the order of their format bits; per version, check words of a block, and blocks.
LEVELS = "MLHQ"
CHECK_WORDS = {
    "L": (7, 10, 15, 20, 26, 18, 20, 24, 30, 18, 20, 24, 26, 30, 22, 24, 28, 30, 28, 28),
    "M": (10, 16, 26, 18, 24, 16, 18, 22, 22, 26, 30, 22, 22, 24, 24, 28, 28, 26, 26, 26),
    "Q": (13, 22, 18, 26, 18, 24, 18, 22, 20, 24, 28, 26, 24, 20, 30, 24, 28, 28, 26, 30),
    "H": (17, 28, 22, 16, 22, 28, 26, 26, 24, 28, 24, 28, 22, 24, 24, 30, 28, 28, 26, 28),
}
BLOCKS = {
    "L": (1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4, 6, 6, 6, 6, 7, 8),
    "M": (1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 5, 8, 9, 9, 10, 10, 11, 13, 14, 16),
    "Q": (1, 1, 2, 2, 4, 4, 6, 6, 8, 8, 8, 10, 12, 16, 12, 17, 16, 18, 21, 20),
    "H": (1, 1, 2, 4, 4, 4, 5, 6, 8, 8, 11, 11, 16, 16, 18, 16, 19, 21, 25, 25),
}
VERSIONS = 20
ALPHANUMERIC = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ $%*+-./:"
_FORMAT_GENERATOR, _FORMAT_MASK, _FIELD = 0x537, 0x5412, 0x11D


def _field() -> tuple[list[int], list[int]]:
    exp, log, x = [0] * 510, [0] * 256, 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (_FIELD if x & 128 else 0)
    return exp, log


EXP, LOG = _field()
_EXPS, _LOGS = np.array(EXP), np.array(LOG)


def times(a: int, b: int) -> int:
    return EXP[LOG[a] + LOG[b]] if a and b else 0


def corrected(words: list[int], checks: int) -> list[int] | None:
    """A block with its errors mended, of which there may be checks // 2; None if there are more."""
    n = len(words)
    said = np.array(words)
    at = np.flatnonzero(said)
    powers = (_LOGS[said[at]] + np.arange(checks)[:, None] * (n - 1 - at)) % 255
    syndromes = np.bitwise_xor.reduce(_EXPS[powers], axis=1).tolist()
    if not any(syndromes):
        return words
    locator, before, length, gap, last = [1], [1], 0, 1, 1
    for i in range(checks):  # the shortest recurrence that the syndromes follow
        off = syndromes[i]
        for j in range(1, length + 1):
            off ^= times(locator[j] if j < len(locator) else 0, syndromes[i - j])
        if not off:
            gap += 1
            continue
        scale = times(off, EXP[255 - LOG[last]])
        longer = locator + [0] * max(0, gap + len(before) - len(locator))
        for j, b in enumerate(before):
            longer[j + gap] ^= times(scale, b)
        if 2 * length <= i:
            before, last, length, gap = locator, off, i + 1 - length, 1
        else:
            gap += 1
        locator = longer
    if length > checks // 2:
        return None
    value = lambda poly, x: _value(poly, x)
    wrong = [p for p in range(n) if value(locator, EXP[(255 - p) % 255]) == 0]  # powers of the places of errors
    if len(wrong) != length:
        return None
    product = [0] * checks
    for i in range(checks):
        for j in range(min(i, len(locator) - 1) + 1):
            product[i] ^= times(locator[j], syndromes[i - j])
    slope = [c if i % 2 else 0 for i, c in enumerate(locator)][1:]  # of the locator
    out = list(words)
    for p in wrong:
        at = EXP[(255 - p) % 255]
        down = value(slope, at)
        if not down:
            return None
        out[n - 1 - p] ^= times(EXP[p % 255], times(value(product, at), EXP[255 - LOG[down]]))
    return out


def _value(poly: list[int], x: int) -> int:
    out = 0
    for c in reversed(poly):
        out = times(out, x) ^ c
    return out


def size_of(version: int) -> int:
    return 17 + 4 * version


@lru_cache
def function_modules(version: int) -> np.ndarray:
    """Which modules hold no data."""
    n = size_of(version)
    out = np.zeros((n, n), bool)
    out[:9, :9] = out[:9, n - 8 :] = out[n - 8 :, :9] = True
    out[6] = out[:, 6] = True
    for y in alignments(version):
        for x in alignments(version):
            if not out[y, x] or (y == 6) != (x == 6):
                if (y, x) not in ((6, 6), (6, n - 7), (n - 7, 6)):
                    out[y - 2 : y + 3, x - 2 : x + 3] = True
    if version >= 7:
        out[:6, n - 11 : n - 8] = out[n - 11 : n - 8, :6] = True
    return out


def alignments(version: int) -> list[int]:
    if version == 1:
        return []
    n = version // 7 + 2
    step = (version * 4 + n * 2 + 1) // (n * 2 - 2) * 2
    return [6, *sorted(size_of(version) - 7 - i * step for i in range(n - 1))]


@lru_cache
def places(version: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the data modules in the order of their bits: pairs of columns from the right, up and down in turn."""
    n, rows, columns = size_of(version), [], []
    free = ~function_modules(version)
    up = True
    for right in [*range(n - 1, 6, -2), *range(5, 0, -2)]:
        for y in range(n - 1, -1, -1) if up else range(n):
            for x in (right, right - 1):
                if free[y, x]:
                    rows.append(y)
                    columns.append(x)
        up = not up
    return np.array(rows), np.array(columns)


def masked(mask: int, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    rules = (
        lambda: (x + y) % 2,
        lambda: y % 2,
        lambda: x % 3,
        lambda: (x + y) % 3,
        lambda: (x // 3 + y // 2) % 2,
        lambda: x * y % 2 + x * y % 3,
        lambda: (x * y % 2 + x * y % 3) % 2,
        lambda: ((x + y) % 2 + x * y % 3) % 2,
    )
    return rules[mask]() == 0


def format_bits(level: str, mask: int) -> int:
    data = LEVELS.index(level) << 3 | mask
    rest = data
    for _ in range(10):
        rest = rest << 1 ^ (rest >> 9) * _FORMAT_GENERATOR
    return (data << 10 | rest) ^ _FORMAT_MASK


def format_places(n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(row, column) of each of 15 bits, lowest first, in both copies."""
    one = [(i, 8) for i in range(6)] + [(7, 8), (8, 8), (8, 7)] + [(8, 14 - i) for i in range(9, 15)]
    return one, [(8, n - 1 - i) for i in range(8)] + [(n - 15 + i, 8) for i in range(8, 15)]


_FORMATS = {format_bits(level, mask): (level, mask) for level in LEVELS for mask in range(8)}


def block_sizes(version: int, level: str) -> list[int]:
    """Data words of each block; the longer ones come last."""
    n, checks = BLOCKS[level][version - 1], CHECK_WORDS[level][version - 1]
    words = len(places(version)[0]) // 8
    return [words // n - checks + (i >= n - words % n) for i in range(n)]


def _blocks(words: list[int], version: int, level: str) -> list[int] | None:
    """Data words of interleaved blocks, corrected."""
    sizes, checks = block_sizes(version, level), CHECK_WORDS[level][version - 1]
    blocks: list[list[int]] = [[] for _ in sizes]
    feed = iter(words)
    for i in range(max(sizes)):
        for b, size in zip(blocks, sizes):
            if i < size:
                b.append(next(feed))
    for _ in range(checks):
        for b in blocks:
            b.append(next(feed))
    out = []
    for b, size in zip(blocks, sizes):
        good = corrected(b, checks)
        if good is None:
            return None
        out += good[:size]
    return out


def _said(words: list[int], version: int) -> str | None:
    """The text of the segments; bytes that are not UTF-8 are replaced."""
    bits, at, out = "".join(f"{w:08b}" for w in words), 0, b""
    wide = 0 if version < 10 else 1

    def take(n: int) -> int:
        nonlocal at
        at += n
        return int(bits[at - n : at] or "0", 2)

    while at + 4 <= len(bits):
        mode = take(4)
        if mode == 0:
            break
        if mode == 7:  # a character set: texts are read as UTF-8 whatever it says
            first = take(8)
            take(0 if first < 128 else 8 if first < 192 else 16)
        elif mode == 4:
            n = take((8, 16)[wide])
            if at + 8 * n > len(bits):
                return None
            out += bytes(take(8) for _ in range(n))
        elif mode == 1:
            n = take((10, 12)[wide])
            while n > 0:
                k = min(n, 3)
                out += f"{take((4, 7, 10)[k - 1]):0{k}}".encode()
                n -= k
        elif mode == 2:
            n = take((9, 11)[wide])
            while n > 0:
                v = take(11 if n > 1 else 6)
                if v >= (2025 if n > 1 else 45):
                    return None
                out += (ALPHANUMERIC[v // 45] * (n > 1) + ALPHANUMERIC[v % 45]).encode()
                n -= 2
        elif mode == 8:
            for _ in range(take((8, 10)[wide])):
                v = take(13)
                v = v // 192 << 8 | v % 192
                v += 0x8140 if v < 0x1F00 else 0xC140
                out += v.to_bytes(2, "big").decode("shift_jis", "replace").encode()
        elif mode not in (3, 5, 9):
            return None
        else:
            return None
        if at > len(bits):
            return None
    return out.decode("utf-8", "replace")


def read_modules(dark: np.ndarray) -> str | None:
    """The text of a code's modules, or None."""
    n = len(dark)
    version = (n - 17) // 4
    if n != size_of(version) or not 1 <= version <= VERSIONS:
        return None
    for copy in format_places(n):
        got = sum(int(dark[y, x]) << i for i, (y, x) in enumerate(copy))
        near = min(_FORMATS, key=lambda f: (f ^ got).bit_count())
        if (near ^ got).bit_count() > 3:
            continue
        level, mask = _FORMATS[near]
        y, x = places(version)
        bits = dark[y, x] ^ masked(mask, y, x)
        words = np.packbits(bits[: len(bits) // 8 * 8]).tolist()
        data = _blocks(words, version, level)
        if data is not None:
            return _said(data, version)
    return None


def _threshold(grey: np.ndarray) -> float:
    """Between dark and light, so that the two differ most."""
    count = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, value = np.cumsum(count), np.cumsum(count * np.arange(256))
    rest = below[-1] - below
    ok = (below > 0) & (rest > 0)
    if not ok.any():
        return 0.0
    spread = np.zeros(256)
    spread[ok] = below[ok] * rest[ok] * (value[ok] / below[ok] - (value[-1] - value[ok]) / rest[ok]) ** 2
    best = np.flatnonzero(spread == spread.max())
    return (best[0] + best[-1]) / 2 + 0.5


def _runs(lines: np.ndarray) -> tuple[list[list[int]], list[int], np.ndarray]:
    """(starts, sums, first): of all lines at once, five runs in the ratio of a corner pattern that begin dark; a start for each
    run, and their sum. Line i's are those from first[i] to first[i + 1], from left to right."""
    count, width = lines.shape
    new = np.ones((count, width), bool)
    np.not_equal(lines[:, 1:], lines[:, :-1], out=new[:, 1:])
    edges = np.flatnonzero(new)  # each line begins a run, so no run goes on in the next line
    if len(edges) < 5:
        return [], [], np.zeros(count + 1, np.int64)
    sizes = np.diff(edges, append=count * width)
    line = edges // width
    at = np.flatnonzero(lines.reshape(-1)[edges[:-4]] & (line[:-4] == line[4:]))
    five = np.lib.stride_tricks.sliding_window_view(sizes, 5)[at]
    unit = five.sum(1) / 7
    fits = (np.abs(five - unit[:, None] * (1, 1, 3, 1, 1)) <= unit[:, None] * (0.6, 0.6, 1.1, 0.6, 0.6)).all(1) & (unit >= 1)
    at, sums = at[fits], five[fits].sum(1)
    return (edges[at[:, None] + np.arange(5)] % width).tolist(), sums.tolist(), np.searchsorted(line[at], np.arange(count + 1))


def _corners(dark: np.ndarray) -> list[tuple[float, float, float]]:
    """(row, column, module size) of corner patterns: found along rows, confirmed along columns, and then along rows again."""
    found: list[list[float]] = []
    rows, wide, in_row = _runs(dark)
    if not rows:
        return []
    columns, high, in_column = _runs(np.ascontiguousarray(dark.T))
    for y in range(len(dark)):
        for s, total in zip(rows[in_row[y] : in_row[y + 1]], wide[in_row[y] : in_row[y + 1]]):
            x = (s[2] + s[3]) / 2
            own = slice(in_column[int(x)], in_column[int(x) + 1])
            for c, tall in zip(columns[own], high[own]):
                if c[2] <= y < c[3] and 0.6 < tall / total < 1.6:
                    middle = int((c[2] + c[3]) / 2)
                    again = slice(in_row[middle], in_row[middle + 1])
                    near = [(r[2] + r[3]) / 2 for r, w in zip(rows[again], wide[again]) if r[2] <= x < r[3] and 0.6 < w / total < 1.6]
                    if not near:
                        continue
                    one = [(c[2] + c[3]) / 2, near[0], (total + tall) / 14, 1]
                    for f in found:
                        if abs(f[0] / f[3] - one[0]) < 1.2 * one[2] and abs(f[1] / f[3] - one[1]) < 1.2 * one[2]:
                            for i in range(4):
                                f[i] += one[i]
                            break
                    else:
                        found.append(one)
    return [(y / n, x / n, m / n) for y, x, m, n in found]


def _framed(corners: tuple) -> tuple[float, list[np.ndarray]] | None:
    """(how far from a right angle of equal legs, [top left, top right, bottom left]) of three corners."""
    p = [np.array(c[:2]) for c in corners]
    sizes = [c[2] for c in corners]
    if max(sizes) > 1.6 * min(sizes):
        return None
    best = None
    for i in range(3):
        a, b, c = p[i], p[(i + 1) % 3], p[(i + 2) % 3]
        u, v = b - a, c - a
        lu, lv = float(np.hypot(*u)), float(np.hypot(*v))
        if min(lu, lv) < 10 * min(sizes):
            continue
        off = abs(float(u @ v)) / (lu * lv) + abs(lu - lv) / max(lu, lv)
        if best is None or off < best[0]:
            if u[1] * v[0] - u[0] * v[1] < 0:  # clockwise, as rows go down
                b, c = c, b
            best = off, [a, b, c]
    return best if best and best[0] < 0.35 else None


def _sampled(dark: np.ndarray, frame: list[np.ndarray], n: int) -> np.ndarray | None:
    a, b, c = frame
    i = (np.arange(n) + 0.5 - 3.5) / (n - 7)
    at = a + i[None, :, None] * (b - a) + i[:, None, None] * (c - a)
    y, x = np.floor(at[..., 0]).astype(int), np.floor(at[..., 1]).astype(int)
    if y.min() < 0 or x.min() < 0 or y.max() >= dark.shape[0] or x.max() >= dark.shape[1]:
        return None
    return dark[y, x]


def read_codes(grey: np.ndarray) -> list[str]:
    """The texts of the codes in a grey grid (rows, columns) of 0 to 255, from top to bottom."""
    if grey.ndim != 2 or min(grey.shape) < 21:
        return []
    dark = grey < _threshold(grey)
    framed = [(f, at) for at in combinations(_corners(dark), 3) if (f := _framed(at))]
    out, used = [], set()
    for (_, frame), at in sorted(framed, key=lambda x: x[0][0]):
        if used & set(at):
            continue
        unit = sum(c[2] for c in at) / 3
        across = (np.hypot(*(frame[1] - frame[0])) + np.hypot(*(frame[2] - frame[0]))) / 2
        turn = max(abs(frame[1] - frame[0])) / np.hypot(*(frame[1] - frame[0]))  # runs along rows of a turned code are longer
        guess = (across / (unit * turn) + 7 - 17) / 4
        for version in sorted(range(1, VERSIONS + 1), key=lambda v: abs(v - guess))[:5]:
            modules = _sampled(dark, frame, size_of(version))
            said = read_modules(modules) if modules is not None and _timed(modules) else None
            if said is not None:
                out.append((frame[0][0], said))
                used |= set(at)
                break
    return [said for _, said in sorted(out)]


def _timed(modules: np.ndarray) -> bool:
    """Whether dark and light take turns between the corners, with few exceptions."""
    n = len(modules)
    want = np.arange(8, n - 8) % 2 == 0
    return (modules[6, 8 : n - 8] != want).mean() < 0.3 and (modules[8 : n - 8, 6] != want).mean() < 0.3
