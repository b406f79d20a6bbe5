"""A slow, plain writer of lossless WebP that can use every feature of the format, to test the decoder against."""

import heapq
import random

from marlpath.llm import webp


class Out:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [(value >> i) & 1 for i in range(n)]

    def data(self) -> bytes:
        padded = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(sum(b << i for i, b in enumerate(padded[k : k + 8])) for k in range(0, len(padded), 8))


def huffman(counts: dict[int, int]) -> dict[int, int]:
    """Code lengths of a Huffman code (no deeper than 15 for the small alphabets of the tests)."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    depth = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    assert max(depth.values()) <= 15
    return depth


class Code:
    def __init__(self, counts: dict[int, int], alphabet: int):
        self.alphabet = alphabet
        self.length = huffman(counts or {0: 1})
        self.single = len(self.length) == 1
        self.bits, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in self.length.items()):
            code <<= n - last
            self.bits[s] = int(f"{code:0{n}b}"[::-1], 2)
            code, last = code + 1, n

    def put(self, out: Out, symbol: int) -> None:
        if not self.single:
            out.put(self.bits[symbol], self.length[symbol])

    def header(self, out: Out, rng: random.Random) -> None:
        symbols = sorted(self.length)
        if len(symbols) <= 2 and symbols[-1] < 256 and rng.random() < 0.7:
            out.put(1, 1), out.put(len(symbols) - 1, 1)
            wide = symbols[0] > 1 or rng.random() < 0.5
            out.put(wide, 1), out.put(symbols[0], 8 if wide else 1)
            if len(symbols) == 2:
                out.put(symbols[1], 8)
            return
        row = [self.length.get(s, 0) for s in range(self.alphabet)]
        tokens, i, before = [], 0, 8
        while i < len(row):
            n = 1
            while i + n < len(row) and row[i + n] == row[i]:
                n += 1
            if row[i] == 0 and n >= 11:
                n = min(n, 138)
                tokens.append((18, n - 11, 7))
            elif row[i] == 0 and n >= 3:
                n = min(n, 10)
                tokens.append((17, n - 3, 3))
            elif row[i] and n >= 3 and row[i] == before:
                n = min(n, 6)
                tokens.append((16, n - 3, 2))
            else:
                n = 1
                tokens.append((row[i], 0, 0))
                before = row[i] or before
            i += n
        bounded = rng.random() < 0.5
        if bounded:
            while tokens and tokens[-1][0] in (0, 17, 18):
                tokens.pop()
            bounded = len(tokens) >= 2
            tokens = tokens if bounded else [(x, 0, 0) for x in row]
        counts: dict[int, int] = {}
        for t in tokens:
            counts[t[0]] = counts.get(t[0], 0) + 1
        inner = Code(counts, 19)
        if max(inner.length.values()) > 7:
            inner.length = {s: 4 if s < 16 else 0 for s in range(16)} | {}
            raise AssertionError("the test's code lengths need more than 7 bits")
        out.put(0, 1), out.put(15, 4)
        for s in webp.LENGTH_ORDER:
            out.put(inner.length.get(s, 0), 3)
        out.put(bounded, 1)
        if bounded:
            size = max(1, (len(tokens) - 2).bit_length())
            size += size % 2
            out.put((size - 2) // 2, 3), out.put(len(tokens) - 2, size)
        for t, extra, n in tokens:
            inner.put(out, t)
            out.put(extra, n)


def prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance code."""
    for symbol in range(40):
        extra = 0 if symbol < 4 else (symbol - 2) >> 1
        base = symbol + 1 if symbol < 4 else ((2 + (symbol & 1)) << extra) + 1
        if base <= value < base + (1 << extra):
            return symbol, value - base, extra
    raise AssertionError


def entropy(out: Out, pixels: list[int], width: int, rng: random.Random, main: bool, cache_bits: int = 0, copies: bool = False, tile_bits: int = 0) -> None:
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    height = len(pixels) // width
    groups, of = 1, lambda i: 0
    if main:
        out.put(tile_bits > 0, 1)
        if tile_bits:
            out.put(tile_bits - 2, 3)
            across = -(-width >> tile_bits) if False else (width + (1 << tile_bits) - 1) >> tile_bits
            down = (height + (1 << tile_bits) - 1) >> tile_bits
            groups = 3
            tiles = [i % groups for i in range(across * down)]
            if len(tiles) < groups:
                groups = len(tiles)
            entropy(out, [t << 8 for t in tiles], across, rng, False)
            of = lambda i: tiles[(i // width >> tile_bits) * across + (i % width >> tile_bits)]
    near = [tuple(p) for p in webp.near_distances().tolist()]
    cache, tokens, i = [0] * (1 << cache_bits), [], 0
    slot = lambda p: ((p * webp.CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(pixels):
        best = (0, 0)
        if copies:
            for d in range(1, min(i, 300) + 1):
                n = 0
                while i + n < len(pixels) and n < 200 and pixels[i + n] == pixels[i + n - d]:
                    n += 1
                best = max(best, (n, -d))
        if best[0] >= 2:
            n, d = best[0], -best[1]
            code = next((k + 1 for k, (x, y) in enumerate(near) if max(1, x + y * width) == d), d + 120)
            tokens.append((i, "copy", n, code))
        elif cache_bits and cache[slot(pixels[i])] == pixels[i]:
            n = 1
            tokens.append((i, "cache", slot(pixels[i]), 0))
        else:
            n = 1
            tokens.append((i, "plain", pixels[i], 0))
        for p in pixels[i : i + n]:
            if cache_bits:
                cache[slot(p)] = p
        i += n
    sizes = [280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40]
    spelled, counts = [], [[{} for _ in range(5)] for _ in range(groups)]

    def use(g, k, s):
        counts[g][k][s] = counts[g][k].get(s, 0) + 1
        return g, k, s

    for at, kind, a, b in tokens:
        g = of(at)
        if kind == "plain":
            spelled.append([use(g, 0, (a >> 8) & 255), use(g, 1, (a >> 16) & 255), use(g, 2, a & 255), use(g, 3, a >> 24)])
        elif kind == "cache":
            spelled.append([use(g, 0, 280 + a)])
        else:
            s, e, n = prefix(a)
            s2, e2, n2 = prefix(b)
            spelled.append([use(g, 0, 256 + s), (e, n), use(g, 4, s2), (e2, n2)])
    codes = [[Code(c, size) for c, size in zip(own, sizes)] for own in counts]
    for own in codes:
        for c in own:
            c.header(out, rng)
    for parts in spelled:
        for p in parts:
            if len(p) == 3:
                codes[p[0]][p[1]].put(out, p[2])
            else:
                out.put(*p)


def write(pixels: list[int], width: int, steps: list, seed: int = 0, **options) -> bytes:
    """A file of ``pixels`` that are already transformed; ``steps`` are ("predictor" | "cross", bits, data), ("green",) or ("palette", colours)."""
    rng = random.Random(seed)
    out = Out()
    coded = options.pop("coded_width", width)
    height = len(pixels) // coded
    out.put(webp.SIGNATURE, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(1, 1), out.put(0, 3)
    across = width
    for step in steps:
        out.put(1, 1)
        if step[0] in ("predictor", "cross"):
            out.put(0 if step[0] == "predictor" else 1, 2), out.put(step[1] - 2, 3)
            entropy(out, step[2], (across + (1 << step[1]) - 1) >> step[1], rng, False)
        elif step[0] == "green":
            out.put(2, 2)
        else:
            out.put(3, 2), out.put(len(step[1]) - 1, 8)
            delta = [step[1][0]] + [sum(((((b >> s) - (a >> s)) & 255) << s) for s in (0, 8, 16, 24)) for a, b in zip(step[1], step[1][1:])]
            entropy(out, delta, len(delta), rng, False)
            across = coded
    out.put(0, 1)
    entropy(out, pixels, coded, rng, True, **options)
    data = out.data()
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
