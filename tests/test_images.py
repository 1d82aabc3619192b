"""Screenshots: resampling against a convolution value by value, codes read back, brand images."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators import images as I
from pagelens.operators import landed as N
from pagelens.operators import symbols as S
from pagelens.sources import symbols as R
from pagelens.sources.captures import screenshots


def kernel(x):
    return 0.0 if abs(x) >= 3 else 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3)


def brute_line(line, wanted):
    out, scale = [], len(line) / wanted
    wide = max(1.0, scale)
    for i in range(wanted):
        centre = (i + 0.5) * scale
        at = range(max(0, int(centre - 3 * wide + 0.5)), min(len(line), int(centre + 3 * wide + 0.5)))
        w = [kernel((x - centre + 0.5) / wide) for x in at]
        whole = [int(v / sum(w) * (1 << 22) + (0.5 if v / sum(w) >= 0 else -0.5)) for v in w]
        out.append(min(255, max(0, (sum(a * line[x] for a, x in zip(whole, at)) + (1 << 21)) >> 22)))
    return out


@pytest.mark.parametrize("width,height", [(9, 8), (1, 1), (5, 40), (100, 3), (37, 53), (9, 200), (640, 8)])
def test_resampling(width, height):
    rnd = np.random.default_rng(width)
    grey = rnd.integers(0, 256, (height, width), dtype=np.uint8)
    rows = [brute_line(r, 9) if width != 9 else r for r in grey.tolist()]
    columns = [brute_line(list(c), 8) if height != 8 else list(c) for c in zip(*rows)]
    assert I.shrunk(grey, 9, 8).tolist() == [list(r) for r in zip(*columns)]


def test_hashes(spark):
    rnd = np.random.default_rng(3)
    shots, want = [], {}
    for i, (w, h, c) in enumerate([(9, 8, 1), (30, 20, 3), (64, 64, 4), (5, 5, 2)]):
        x = rnd.integers(0, 256, (h, w, c), dtype=np.uint8)
        grey = [[(int(p[0]) if c < 3 else (19595 * int(p[0]) + 38470 * int(p[1]) + 7471 * int(p[2]) + 0x8000) >> 16) for p in r] for r in x]
        small = I.shrunk(np.array(grey, np.uint8), 9, 8)
        want[i] = sum(int(small[k // 8, k % 8] > small[k // 8, k % 8 + 1]) << (63 - k) for k in range(64))
        shots.append((i, w, h, c, x.tobytes()))
    shots += [(10, 2, 2, 1, b"abc"), (11, 0, 5, 1, b""), (12, None, 2, 1, b"ab"), (13, 1, 1, 1, None), (14, 1, 1, 9, b"123456789")]
    df = spark.createDataFrame(shots, "id int, width int, height int, channels int, pixels binary")
    got = {r.id: r.hash for r in I.hashed(df).collect()}
    assert {i: got[i] % (1 << 64) for i in want} == want and all(got[i] is None for i in range(10, 15))
    assert I.hashed(df.limit(0)).count() == 0


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(x, kind, filters, extra=b""):
    """Stored with the given filter of each row."""
    h, w, c = x.shape
    raw, up = b"", np.zeros(w * c, int)
    for y in range(h):
        line, f = x[y].ravel().astype(int), filters[y % len(filters)]
        left = np.concatenate([np.zeros(c, int), line[:-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        raw += bytes([f]) + ((line - (0, left, up, (left + up) // 2, near)[f]) % 256).astype(np.uint8).tobytes()
        up = line
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_brand_images(spark, tmp_path):
    rnd = np.random.default_rng(5)
    x = rnd.integers(0, 256, (11, 13, 3), dtype=np.uint8)
    for kind, c in ((0, 1), (2, 3), (4, 2), (6, 4)):
        y = rnd.integers(0, 256, (11, 13, c), dtype=np.uint8)
        got = I.png_pixels(png(y, kind, [0, 1, 2, 3, 4]))
        assert got == {"width": 13, "height": 11, "channels": c, "pixels": y.tobytes()}
    colours = rnd.integers(0, 256, (256, 3), dtype=np.uint8)
    y = rnd.integers(0, 256, (4, 4, 1), dtype=np.uint8)
    assert I.png_pixels(png(y, 3, [4], chunk(b"PLTE", colours.tobytes())))["pixels"] == colours[y[:, :, 0]].tobytes()
    good = png(x, 2, [4, 3])
    for bad in (None, b"", b"GIF89a", good[:50], good[:-40], good.replace(b"IHDR", b"IHDX")):
        assert I.png_pixels(bad) is None
    (tmp_path / "bank.png").write_bytes(good)
    (tmp_path / "broken.png").write_bytes(good[:60])
    (tmp_path / "notes.txt").write_bytes(b"x")
    refs = N.reference_images(spark, str(tmp_path))
    assert [r.brand for r in refs.collect()] == ["bank", "broken"]
    brands = I.reference_hashes(refs)
    shot = spark.createDataFrame([(1, 13, 11, 3, x.tobytes()), (2, 13, 11, 3, (255 - x).tobytes())], "id int, width int, height int, channels int, pixels binary")
    found = N.visual_matches(I.hashed(shot), brands).collect()
    assert [(r.id, r.brand, r.distance, r.similarity) for r in found] == [(1, "bank", 0, 1.0)]


def test_standard_examples():
    """Worked examples of the standard: check words of a block, format bits, words of each version."""
    data = [32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17]
    assert R.checks_of(data, 10) == [196, 35, 39, 119, 235, 215, 231, 226, 93, 23]
    assert S._said(data, 1) == "HELLO WORLD"
    assert S.format_bits("L", 4) == 0b110011000101111 and S.format_bits("M", 0) == 0b101010000010010
    assert [len(S.places(v)[0]) // 8 for v in (1, 2, 6, 7, 10, 14, 20)] == [26, 44, 172, 196, 346, 581, 1085]
    assert sum(S.block_sizes(5, "Q")) == 62 and S.block_sizes(5, "Q") == [15, 15, 16, 16]
    assert S.alignments(7) == [6, 22, 38] and S.alignments(14) == [6, 26, 46, 66]


def test_correction():
    rnd = random.Random(7)
    for _ in range(100):
        checks, n = rnd.choice([7, 10, 16, 30]), rnd.randint(5, 100)
        data = [rnd.randrange(256) for _ in range(n)]
        block = data + R.checks_of(data, checks)
        for errors in (0, 1, checks // 2):
            bad = list(block)
            for i in rnd.sample(range(len(bad)), errors):
                bad[i] ^= rnd.randrange(1, 256)
            assert S.corrected(bad, checks) == block
        bad = list(block)
        for i in rnd.sample(range(len(bad)), min(len(bad), checks // 2 + 3)):
            bad[i] ^= rnd.randrange(1, 256)
        assert S.corrected(bad, checks) != block


def turned(grey, degrees):
    """A picture turned about its middle on a larger light ground."""
    n = int(max(grey.shape) * 1.6)
    y, x = np.mgrid[:n, :n] - n / 2 + 0.5
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    v, u = np.floor(c * y - s * x + grey.shape[0] / 2).astype(int), np.floor(s * y + c * x + grey.shape[1] / 2).astype(int)
    inside = (v >= 0) & (u >= 0) & (v < grey.shape[0]) & (u < grey.shape[1])
    out = np.full((n, n), 235, np.uint8)
    out[inside] = grey[v[inside], u[inside]]
    return out


def test_codes():
    rnd = random.Random(1)
    for k in range(24):
        text, level = "https://x.example/" + "".join(rnd.choices("abcdé/?=&", k=rnd.choice([3, 40, 120, 260]))), "LMQH"[k % 4]
        modules = R.code_of(text, level, k % 8)
        most = S.CHECK_WORDS[level][(len(modules) - 17) // 4 - 1] // 2
        assert S.read_codes(R.drawn(R.damaged(modules, most, k), 2 + k % 3, turns=k % 4)) == [text]
    text = "https://pay.example/?amount=100"
    for degrees in (3, 11, 30, 45, 77, 190, 285):
        assert S.read_codes(turned(R.drawn(R.code_of(text), 5), degrees)) == [text]
    two = np.full((300, 320), 240, np.uint8)
    for at, t in ((10, "one"), (180, "two")):
        g = R.drawn(R.code_of(t), 4)
        two[at : at + len(g), at : at + len(g)] = g
    assert S.read_codes(two) == ["one", "two"]
    noise = np.random.default_rng(1).integers(0, 256, (200, 200), dtype=np.uint8)
    assert S.read_codes(noise) == S.read_codes(np.zeros((100, 100), np.uint8)) == S.read_codes(np.zeros((5, 5), np.uint8)) == []
    assert S.read_codes(R.drawn(~R.code_of("inverse"))) == []
    with pytest.raises(ValueError):
        R.code_of("x" * 2000)


def test_codes_of_screenshots(spark):
    g = R.drawn(R.code_of("gcash pay"))
    shots = [(1, g.shape[1], g.shape[0], 1, g.tobytes()), (2, 4, 4, 1, b"x" * 16), (3, None, 1, 1, b"x"), (4, g.shape[1], g.shape[0], 3, np.repeat(g[:, :, None], 3, 2).tobytes())]
    got = I.decoded(spark.createDataFrame(shots, "scan_id int, width int, height int, channels int, pixels binary")).orderBy("scan_id").collect()
    assert [tuple(r) for r in got] == [(1, "QRCODE", "gcash pay"), (4, "QRCODE", "gcash pay")]


def test_corner_runs_of_all_lines_at_once(monkeypatch):
    rnd = np.random.default_rng(5)
    for width in (1, 4, 40):
        lines = np.repeat(rnd.integers(0, 2, (30, width)), 2, 1).astype(bool)
        lines[:10, : 2 * (width // 9) * 9] = np.tile(np.array([0, 1, 0, 1, 1, 1, 0, 1, 0], bool).repeat(2), width // 9)
        starts, sums, first = S._runs(lines)
        for y, line in enumerate(lines):
            want, edges = [], [i for i in range(len(line)) if i == 0 or line[i] != line[i - 1]] + [len(line)]
            for at in range(len(edges) - 5):
                sizes = np.diff(edges[at : at + 6])
                unit = sizes.sum() / 7
                if line[edges[at]] and unit >= 1 and all(abs(n - unit * k) <= unit * (1.1 if k == 3 else 0.6) for n, k in zip(sizes, (1, 1, 3, 1, 1))):
                    want.append((edges[at : at + 5], sizes.sum()))
            assert list(zip(starts, sums))[first[y] : first[y + 1]] == want
    runs, calls = S._runs, []
    monkeypatch.setattr(S, "_runs", lambda lines: calls.append(1) or runs(lines))
    assert S.read_codes(R.drawn(R.code_of("x" * 200), 4)) == ["x" * 200]
    assert len(calls) == 2  # all rows at once, all columns at once


def test_screenshots_of_one_file_are_drawn_by_many_tasks(spark, tmp_path):
    rows = [(i, f"https://x.example/{i}") for i in range(600)] + [(600, ""), (601, None)]
    spark.createDataFrame(rows, "page_id bigint, url string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    shots = screenshots(spark.read.parquet(str(tmp_path / "pages")))
    assert shots.rdd.getNumPartitions() >= 4
    assert shots.columns == ["scan_id", "width", "height", "channels", "pixels"]
    assert sorted((r.scan_id, r.payload) for r in I.decoded(shots).collect()) == rows[:600]
