"""Lossless WebP images, many at a time: decoding of the whole format, and an encoder that picks its means by image, in numpy.

Images are decoded side by side: every step decodes one pixel of each image that still has one, so that the cost of a
numpy call is shared by all. Bits are read in the order of the format, least significant first.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the order in which lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Alphabets of the five prefix codes (the first also holds the cache's codes), and the cache's multiplier.
ALPHABETS = (280, 256, 256, 256, 40)
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
OPAQUE = 0xFF000000


@lru_cache(maxsize=1)
def near_distances() -> np.ndarray:
    """(dx, dy) of the 120 short distance codes: places above or to the left, nearest first, then the smaller |dx|, then the right one."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    places.sort(key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
    return np.array(places, np.int64)


@lru_cache(maxsize=16)
def reversed_bits(n: int) -> np.ndarray:
    x = np.arange(1 << n)
    out = np.zeros_like(x)
    for i in range(n):
        out |= ((x >> i) & 1) << (n - 1 - i)
    return out


class Bits:
    """One bit stream for each image, in one buffer; ``at`` is each stream's place in bits."""

    def __init__(self, streams: list[bytes]):
        self.size = np.array([len(s) for s in streams], np.int64)
        first = np.concatenate(([0], np.cumsum(self.size + 8)[:-1])).astype(np.int64)
        self.data = np.frombuffer(b"".join(s + bytes(8) for s in streams) + bytes(16), np.uint8)
        self.words = np.ndarray((len(self.data) - 8,), "<u8", self.data, strides=(1,))
        self.at = first * 8
        self.end = (first + self.size) * 8

    def peek(self, who) -> np.ndarray:
        """At least 57 bits of each stream of ``who`` from its place on."""
        at = np.minimum(self.at[who], self.end[who])
        return self.words[at >> 3] >> (at & 7).astype(np.uint64)

    def read(self, who: np.ndarray, n) -> np.ndarray:
        """``n`` bits (a number or one for each) of the streams ``who``."""
        n = np.broadcast_to(np.asarray(n, np.int64), np.shape(who))
        value = (self.peek(who) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        self.at[who] += n
        if (self.at[who] > self.end[who]).any():
            raise ValueError("the image ends before its data")
        return value


def tables(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Lookup tables of prefix codes given as rows of code lengths: row, next bits -> symbol * 16 + length; and the bits a lookup takes.

    A row with one symbol takes no bits; other rows must be complete.
    """
    longest = max(1, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), 1 << longest), np.uint32)
    turn = reversed_bits(longest)
    for i, row in enumerate(lengths):
        symbols = np.flatnonzero(row)
        if len(symbols) <= 1:
            out[i] = (int(symbols[0]) if len(symbols) else 0) << 4
            continue
        own = row[symbols].astype(np.int64)
        order = np.argsort(own, kind="stable")
        span = np.int64(1) << (longest - own[order])
        if span.sum() != 1 << longest:
            raise ValueError("a prefix code isn't complete")
        out[i] = np.repeat((symbols[order].astype(np.uint32) << np.uint32(4)) | own[order].astype(np.uint32), span)[turn]
    return out, longest


def read_lengths(bits: Bits, who: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code lengths of one prefix code of each image, as rows padded to the largest alphabet."""
    out = np.zeros((len(who), int(sizes.max())), np.uint8)
    simple = bits.read(who, 1) == 1
    if simple.any():
        own = np.flatnonzero(simple)
        two = bits.read(who[own], 1)
        first = bits.read(who[own], np.where(bits.read(who[own], 1) == 1, 8, 1))
        pair = own[two == 1]
        second = bits.read(who[pair], 8)
        if (first >= sizes[own]).any() or (second >= sizes[pair]).any():
            raise ValueError("a symbol is outside its alphabet")
        out[own, first] = 1
        out[pair, second] = 1
    own = np.flatnonzero(~simple)
    if not len(own):
        return out
    given = bits.read(who[own], 4) + 4
    small = np.zeros((len(own), 19), np.uint8)
    for k in range(int(given.max())):
        has = np.flatnonzero(given > k)
        small[has, LENGTH_ORDER[k]] = bits.read(who[own[has]], 3)
    left = sizes[own].copy()
    bounded = np.flatnonzero(bits.read(who[own], 1) == 1)
    if len(bounded):
        left[bounded] = 2 + bits.read(who[own[bounded]], 2 + 2 * bits.read(who[own[bounded]], 3))
    table, wide = tables(small)
    at, before = np.zeros(len(own), np.int64), np.full(len(own), 8, np.int64)
    while True:
        go = np.flatnonzero((at < sizes[own]) & (left > 0))
        if not len(go):
            return out
        left[go] -= 1
        w = who[own[go]]
        entry = table[go, (bits.peek(w) & np.uint64((1 << wide) - 1)).astype(np.int64)].astype(np.int64)
        bits.at[w] += entry & 15
        symbol = entry >> 4
        plain = symbol < 16
        p = go[plain]
        out[own[p], at[p]] = symbol[plain]
        before[p] = np.where(symbol[plain] > 0, symbol[plain], before[p])
        at[p] += 1
        for code, extra, base in ((16, 2, 3), (17, 3, 3), (18, 7, 11)):
            r = go[symbol == code]
            if len(r):
                n = base + bits.read(who[own[r]], extra)
                if (at[r] + n > sizes[own[r]]).any():
                    raise ValueError("code lengths run over their alphabet")
                if code == 16:
                    for i, k in zip(r, n):
                        out[own[i], at[i] : at[i] + k] = before[i]
                at[r] += n


def prefix_value(bits: Bits, who: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The length or distance code that a prefix symbol and its extra bits stand for."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    base = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra)
    return base + bits.read(who, extra) + 1


def entropy_decode(bits: Bits, who: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> list[np.ndarray]:
    """The pixels (ARGB as uint32, row by row) of one entropy-coded image of each stream of ``who``."""
    if not len(who):
        return []
    n = len(who)
    cache_bits = np.zeros(n, np.int64)
    has = np.flatnonzero(bits.read(who, 1) == 1)
    if len(has):
        cache_bits[has] = bits.read(who[has], 4)
        if ((cache_bits[has] < 1) | (cache_bits[has] > 11)).any():
            raise ValueError("the colour cache must have 1 to 11 bits")
    groups, tile, maps = np.ones(n, np.int64), np.zeros(n, np.int64), [None] * n
    if main:
        meta = np.flatnonzero(bits.read(who, 1) == 1)
        if len(meta):
            tile[meta] = bits.read(who[meta], 3) + 2
            side = np.int64(1) << tile[meta]
            found = entropy_decode(bits, who[meta], (width[meta] + side - 1) // side, (height[meta] + side - 1) // side, False)
            for i, pixels in zip(meta, found):
                maps[i] = ((pixels >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64)
                groups[i] = maps[i].max() + 1
    first = np.concatenate(([0], np.cumsum(groups)[:-1])).astype(np.int64)
    lengths = [np.zeros((int(groups.sum()), a + (1 << int(cache_bits.max()) if k == 0 and cache_bits.any() else 0)), np.uint8) for k, a in enumerate(ALPHABETS)]
    for g in range(int(groups.max())):
        own = np.flatnonzero(groups > g)
        for k, a in enumerate(ALPHABETS):
            sizes = np.full(len(own), a, np.int64)
            if k == 0:
                sizes += np.where(cache_bits[own] > 0, np.int64(1) << cache_bits[own], 0)
            rows = read_lengths(bits, who[own], sizes)
            lengths[k][first[own] + g, : rows.shape[1]] = rows
    table, wide = zip(*(tables(x) for x in lengths))
    flat = [t.reshape(-1) for t in table]
    mask = [np.uint64((1 << b) - 1) for b in wide]
    fixed = [bool((t[:, :1] == t).all()) and not (t & 15).any() for t in table]

    total = width * height
    order = np.argsort(-total, kind="stable")
    who, total, width, cache_bits, tile = who[order], total[order], width[order], cache_bits[order], tile[order]
    base, maps = first[order], [maps[i] for i in order]
    alive_at = np.searchsorted(-total, -np.arange(int(total[0])), "left")  # how many images have a pixel t
    out = np.zeros((int(total[0]), n), np.uint32)
    cached = bool(cache_bits.any())
    most_cache = int(cache_bits.max())
    cache = np.zeros(n << most_cache if cached else 0, np.uint32)
    cache_first = np.arange(n, dtype=np.int64) << most_cache
    cache_shift = (32 - cache_bits).astype(np.uint32)
    runs, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    copying = False
    grouped = any(m is not None for m in maps)
    at, end = bits.at[who], bits.end[who]
    words = bits.words
    lanes = np.arange(n, dtype=np.int64)
    near = near_distances()
    mapped = [i for i in range(n) if maps[i] is not None]

    for t in range(int(total[0])):
        m = int(alive_at[t])
        if grouped:
            for i in mapped:
                if i < m:
                    x, y, side = t % width[i], t // width[i], tile[i]
                    base[i] = first[order[i]] + maps[i][(y >> side) * ((width[i] + (1 << side) - 1) >> side) + (x >> side)]
        still = np.flatnonzero(runs[:m]) if copying else ()  # these copy a pixel; what their bits say here is passed over
        copying = len(still) > 0
        go = slice(0, m)
        place = np.minimum(at[go], end[go])
        window = words[place >> 3] >> (place & 7).astype(np.uint64)
        who_group = base[go]
        entry = flat[0][(who_group << wide[0]) + (window & mask[0]).astype(np.int64)]
        used = entry & np.uint32(15)
        symbol = entry >> np.uint32(4)
        if copying:
            symbol[still] = 0
        special = np.flatnonzero(symbol >= 256)
        pixel = symbol << np.uint32(8)
        taken = used
        for k, shift in ((1, 16), (2, 0)):
            entry = flat[k][(who_group << wide[k]) + ((window >> taken.astype(np.uint64)) & mask[k]).astype(np.int64)]
            pixel |= (entry >> np.uint32(4)) << np.uint32(shift)
            taken = taken + (entry & np.uint32(15))
        if fixed[3]:
            pixel |= (flat[3][who_group << wide[3]] >> np.uint32(4)) << np.uint32(24)
        else:
            later = place + taken
            late = words[np.minimum(later, end[go]) >> 3] >> (later & 7).astype(np.uint64)
            entry = flat[3][(who_group << wide[3]) + (late & mask[3]).astype(np.int64)]
            pixel |= (entry >> np.uint32(4)) << np.uint32(24)
            taken = taken + (entry & np.uint32(15))
        if copying:
            pixel[still] = out[t - back[still], still]
            taken[still] = 0
            runs[still] -= 1
        own = lanes[go]
        if len(special):
            taken = taken.astype(np.int64)
            taken[special] = used[special]
            hit = special[symbol[special] >= 280]
            if len(hit):
                pixel[hit] = cache[cache_first[own[hit]] + (symbol[hit].astype(np.int64) - 280)]
            ref = special[symbol[special] < 280]
            if len(ref):
                images = own[ref]
                bits.at[who[images]] = at[images] + taken[ref]
                length = prefix_value(bits, who[images], symbol[ref].astype(np.int64) - 256)
                late = bits.peek(who[images])
                entry = flat[4][(base[images] << wide[4]) + (late & mask[4]).astype(np.int64)]
                bits.at[who[images]] += (entry & np.uint32(15)).astype(np.int64)
                code = prefix_value(bits, who[images], (entry >> np.uint32(4)).astype(np.int64))
                step = near[np.minimum(code, 120) - 1]
                distance = np.where(code > 120, code - 120, np.maximum(1, step[:, 0] + step[:, 1] * width[images]))
                if (distance > t).any() or (t + length > total[images]).any():
                    raise ValueError("a back-reference leaves the image")
                taken[ref] = bits.at[who[images]] - at[images]
                runs[images], back[images] = length - 1, distance
                pixel[ref] = out[t - distance, images]
                copying = True
        at[go] += taken
        out[t, go] = pixel
        if cached:
            now = out[t, :m]
            slot = (now * np.uint32(CACHE_FACTOR)) >> np.minimum(cache_shift[:m], np.uint32(31))
            if most_cache and (cache_bits[:m] == 0).any():
                slot[cache_bits[:m] == 0] = 0
            cache[cache_first[:m] + slot] = now
    if (at > end).any():
        raise ValueError("the image ends before its data")
    bits.at[who] = at
    pixels: list = [None] * n
    for j, i in enumerate(order):
        pixels[i] = out[: total[j], j].copy()
    return pixels


def channels(argb: np.ndarray) -> np.ndarray:
    """(…, 4) bytes A, R, G, B of uint32 pixels."""
    return np.stack([(argb >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def packed(four: np.ndarray) -> np.ndarray:
    four = four.astype(np.uint32) & np.uint32(255)
    return (four[..., 0] << np.uint32(24)) | (four[..., 1] << np.uint32(16)) | (four[..., 2] << np.uint32(8)) | four[..., 3]


def predict(mode: int, left, top, corner, right) -> np.ndarray:
    """A pixel's prediction, as four channels, from its neighbours' (``corner``: above left, ``right``: above right)."""
    mean = lambda a, b: (a + b) >> 1
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0], np.int32)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode <= 9:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    half = mean(left, top)
    return np.clip(half + np.trunc((half - corner) / 2).astype(np.int32), 0, 255)


def undo_predictor(residual: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Pixels from residuals: each adds the prediction of its block's mode; edges predict from what is there."""
    rest = channels(residual)
    height, width = residual.shape
    mode_of = (modes >> np.uint32(8)) & np.uint32(15)
    first = rest[0].copy()
    first[0, 0] += 255
    first = np.cumsum(first, axis=0)
    if (mode_of == 2).all():  # sums down the columns
        return packed(np.cumsum(np.concatenate((first[None], rest[1:])), axis=0) & 255)
    if (mode_of == 1).all():  # sums along the rows, whose first pixels are summed down
        lead = np.cumsum(np.concatenate((first[None, 0], rest[1:, 0])), axis=0)
        return packed(np.concatenate((first[None], np.cumsum(np.concatenate((lead[1:, None], rest[1:, 1:]), axis=1), axis=1))) & 255)
    out = np.zeros((height, width, 4), np.int32)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = out[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                guess = out[y - 1, 0]
            else:
                right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = predict(int(mode_of[y >> size_bits, x >> size_bits]), out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], right)
            out[y, x] = (rest[y, x] + guess) & 255
    return packed(out)


def signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def undo_cross_colour(argb: np.ndarray, factors: np.ndarray, size_bits: int) -> np.ndarray:
    """Adds to red what its block's factors make of green, and to blue what they make of green and of the new red."""
    height, width = argb.shape
    block = channels(factors)[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]
    c = channels(argb)
    green = signed(c[..., 2])
    c[..., 1] = (c[..., 1] + ((signed(block[..., 3]) * green) >> 5)) & 255
    c[..., 3] = (c[..., 3] + ((signed(block[..., 2]) * green) >> 5) + ((signed(block[..., 1]) * signed(c[..., 1])) >> 5)) & 255
    return packed(c)


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = channels(argb)
    c[..., 1] = (c[..., 1] + c[..., 2]) & 255
    c[..., 3] = (c[..., 3] + c[..., 2]) & 255
    return packed(c)


def undo_palette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Colours of the indices in green, of which up to eight are packed in one pixel; an index beyond the palette is transparent black."""
    shift = palette_shift(len(palette))
    index = ((argb >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    if shift:
        per, size = 1 << shift, 8 >> shift
        index = (index[:, :, None] >> (np.arange(per) * size)) & ((1 << size) - 1)
        index = index.reshape(len(argb), -1)[:, :width]
    return np.concatenate((palette, np.zeros(256, np.uint32)))[index]


def palette_shift(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def chunk_of(image: bytes) -> bytes:
    """The VP8L data of a simple lossless WebP file."""
    if len(image) < 21 or image[:4] != b"RIFF" or image[8:12] != b"WEBP" or image[12:16] != b"VP8L":
        raise ValueError("not a simple lossless WebP file")
    size = int.from_bytes(image[16:20], "little")
    if len(image) < 20 + size or image[20] != SIGNATURE:
        raise ValueError("a damaged lossless WebP file")
    return image[20 : 20 + size]


def decode(images: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file as a (height, width) array of ARGB values."""
    if not images:
        return []
    bits = Bits([chunk_of(i) for i in images])
    everyone = np.arange(len(images))
    bits.read(everyone, 8)
    width, height = bits.read(everyone, 14) + 1, bits.read(everyone, 14) + 1
    bits.read(everyone, 1)
    if bits.read(everyone, 3).any():
        raise ValueError("an unknown version")
    undo: list[list] = [[] for _ in images]
    coded = width.copy()
    who = everyone
    while len(who := who[bits.read(who, 1) == 1]):
        kind = bits.read(who, 2)
        for k in (0, 1):
            own = who[kind == k]
            if len(own):
                size = bits.read(own, 3) + 2
                side = np.int64(1) << size
                w, h = (coded[own] + side - 1) // side, (height[own] + side - 1) // side
                for i, s, ww, pixels in zip(own, size, w, entropy_decode(bits, own, w, h, False)):
                    undo[i].append((k, pixels.reshape(-1, ww), int(s)))
        for i in who[kind == 2]:
            undo[i].append((2,))
        own = who[kind == 3]
        if len(own):
            colours = bits.read(own, 8) + 1
            for i, found in zip(own, entropy_decode(bits, own, colours, np.ones(len(own), np.int64), False)):
                steps = channels(found)
                undo[i].append((3, packed(np.cumsum(steps, axis=0) & 255), int(coded[i])))
                per = 1 << palette_shift(len(found))
                coded[i] = (coded[i] + per - 1) // per
    out = []
    for i, pixels in enumerate(entropy_decode(bits, everyone, coded, height, True)):
        now = pixels.reshape(height[i], coded[i])
        for step in reversed(undo[i]):
            if step[0] == 0:
                now = undo_predictor(now, *step[1:])
            elif step[0] == 1:
                now = undo_cross_colour(now, *step[1:])
            elif step[0] == 2:
                now = undo_subtract_green(now)
            else:
                now = undo_palette(now, *step[1:])
        out.append(now)
    return out


def code_lengths(counts: np.ndarray, longest: int = 14) -> np.ndarray:
    """Lengths of complete prefix codes for rows of counts: -log2 of the shares, rounded up, and then shortened until nothing is left over."""
    total = counts.sum(axis=1, keepdims=True)
    used = counts > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        lengths = np.where(used, np.ceil(np.log2(total / np.maximum(counts, 1)) - 1e-12), 0).astype(np.int64)
    lengths[used] = np.clip(lengths[used], 1, longest)
    many = used.sum(axis=1) > 1
    spare = (1 << longest) - np.where(used, np.int64(1) << (longest - lengths), 0).sum(axis=1)
    if (spare[many] < 0).any():
        raise ValueError("too many pixels for codes of this length")
    spare[~many] = 0
    while spare.any():
        for level in range(2, longest + 1):
            here = lengths == level
            can = np.minimum(here.sum(axis=1), spare >> (longest - level))
            if can.any():
                lengths -= here & (np.cumsum(here, axis=1) <= can[:, None])
                spare -= can << (longest - level)
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of rows of lengths, in the bit order of the format; a row's only symbol has no bits."""
    code, start = np.zeros_like(lengths), np.zeros(len(lengths), np.int64)
    for level in range(1, int(lengths.max(initial=1)) + 1):
        here = lengths == level
        start <<= 1
        code += here * (reversed_bits(level)[np.minimum(start[:, None] + np.cumsum(here, axis=1) - 1, (1 << level) - 1)])
        start += here.sum(axis=1)
    return code


def length_tokens(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bits) of the code-length symbols of all rows, in order: 4 bits each, and the extra bits of runs of zeros."""
    rows, size = lengths.shape
    flat = lengths.reshape(-1)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != 0) | (flat[:-1] != 0)
    new[::size] = True
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(flat)))
    zero = flat[first] == 0
    place, value, bits = [first[~zero]], [flat[first[~zero]]], [np.full((~zero).sum(), 4)]
    first, run = first[zero], run[zero]
    sub = np.zeros(len(first), np.int64)
    while len(first):
        now = np.minimum(run, 138)
        long, mid = now >= 11, (now >= 3) & (now < 11)
        place.append(first + sub)
        value.append(np.where(long, 15 | ((now - 11) << 4), np.where(mid, 14 | ((now - 3) << 4), 0)))
        bits.append(np.where(long, 11, np.where(mid, 7, 4)))
        done = np.where(long | mid, now, 1)
        sub, run = sub + done, run - done
        first, sub, run = first[run > 0], sub[run > 0], run[run > 0]
    place, value, bits = np.concatenate(place), np.concatenate(value), np.concatenate(bits)
    order = np.argsort(place, kind="stable")
    return place[order] // size, value[order], bits[order]


#: The encoder's code-length code has 16 symbols of 4 bits: lengths 0 to 13 and the runs of zeros 17 and 18.
LENGTH_SYMBOLS = [*range(14), 17, 18]


def _length_code_header() -> tuple[int, int]:
    value, n = 15 << 1, 5  # a normal code; 19 lengths follow
    for symbol in LENGTH_ORDER:
        value |= (4 if symbol in LENGTH_SYMBOLS else 0) << n
        n += 3
    return value, n + 1  # all symbols of the alphabet are coded


class Writer:
    """Bits for many streams at once: each call appends to the streams that it names, in order of the calls."""

    def __init__(self, n: int):
        self.n, self.who, self.value, self.bits = n, [], [], []

    def put(self, who, value, bits) -> None:
        who = np.asarray(who, np.int64)
        self.who.append(who)
        self.value.append(np.broadcast_to(np.asarray(value).astype(np.uint64), who.shape))
        self.bits.append(np.broadcast_to(np.asarray(bits, np.int64), who.shape))

    def streams(self) -> list[bytes]:
        size = np.zeros((len(self.who), self.n), np.int64)
        for k, (who, bits) in enumerate(zip(self.who, self.bits)):
            size[k] = np.bincount(who, bits, minlength=self.n).astype(np.int64)
        total = size.sum(axis=0)
        words = (total + 63) // 64 + 1
        base = np.concatenate(([0], np.cumsum(words)[:-1])).astype(np.int64)
        before = np.cumsum(size, axis=0) - size
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        for k, (who, value, bits) in enumerate(zip(self.who, self.value, self.bits)):
            run = np.cumsum(bits) - bits
            own = np.concatenate(([0], np.cumsum(size[k])[:-1]))
            at = base[who] * 64 + before[k][who] + run - own[who]
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.add.at(out, word, value << shift)
            over = np.flatnonzero((at & 63) + bits > 64)
            np.add.at(out, word[over] + 1, value[over] >> (np.uint64(64) - shift[over]))
        raw = out.tobytes()
        return [raw[8 * b : 8 * b + (t + 7) // 8] for b, t in zip(base.tolist(), total.tolist())]


def prefix_symbol(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of lengths or distance codes: prefix_value's inverse."""
    x = value - 1
    high = np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1
    extra = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + ((x >> np.maximum(high - 1, 0)) & 1)), np.where(x < 4, 0, x & ((1 << extra) - 1)), extra


@lru_cache(maxsize=16)
def distance_codes(width: int) -> np.ndarray:
    """The code of each distance in an image of that width: a short one where there is one, else the distance plus 120."""
    table = np.arange(16 * width + 16) + 120
    for code, (dx, dy) in reversed(list(enumerate(near_distances().tolist(), 1))):
        table[max(1, dx + dy * width)] = code
    return table


def repeats(image: np.ndarray, argb: np.ndarray, window: int = 4, least: int = 6, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of back-references that don't overlap: runs of pixels that stand ``distance`` before in the same image.

    Each window's last occurrence before is found by one sort; windows in a row with one distance are one run.
    """
    none = np.empty(0, np.int64)
    m = len(argb) - window + 1
    if m <= 0:
        return none, none, none
    key = image[:m].astype(np.uint64)
    for j in range(window):
        key = (key * np.uint64(0xD1342543DE82EF95)) + argb[j : j + m]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    at, before = order[1:][same], order[:-1][same]
    good = (image[at + window - 1] == image[before]) & (image[before + window - 1] == image[before])
    for j in range(window):
        good &= argb[at + j] == argb[before + j]
    back = np.zeros(m, np.int64)
    back[at[good]] = at[good] - before[good]
    new = back > 0
    new[1:] &= back[1:] != back[:-1]
    start = np.flatnonzero(new)
    edge = np.append(np.flatnonzero(np.diff(back)) + 1, m)
    size = edge[np.searchsorted(edge, start, "right")] - start + window - 1
    found, end = [], 0
    for place, n, distance in zip(start.tolist(), size.tolist(), back[start].tolist()):
        if place < end:
            place, n = end, n - (end - place)
        while n >= least:
            found.append((place, min(n, most), distance))
            place, n = place + found[-1][1], n - found[-1][1]
            end = place
    if not found:
        return none, none, none
    return tuple(np.array(found, np.int64).T)


def put_pixels(out: Writer, who: np.ndarray, image: np.ndarray, argb: np.ndarray, widths: np.ndarray | None, cache_bits: int = 0) -> None:
    """One entropy-coded image for each stream of ``who``: ``image`` says whose each pixel is. With ``widths`` it is the main image, which has back-references."""
    n = len(who)
    out.put(who, 1 | (cache_bits << 1) if cache_bits else 0, 5 if cache_bits else 1)
    if widths is not None:
        out.put(who, 0, 1)  # one group of prefix codes
    alpha, red, green, blue = (((argb >> np.uint32(k)) & np.uint32(255)).astype(np.int64) for k in (24, 16, 8, 0))
    symbol, plain, keep = green, np.ones(len(argb), bool), np.ones(len(argb), bool)
    if cache_bits:
        slot = ((argb * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        order = np.argsort((image << cache_bits) + slot, kind="stable")
        hit = order[1:][(argb[order[1:]] == argb[order[:-1]]) & (image[order[1:]] == image[order[:-1]])]
        plain[hit] = False
        symbol = green.copy()
        symbol[hit] = 280 + slot[hit]
    more_value, more_bits = np.zeros(len(argb), np.uint64), np.zeros(len(argb), np.int64)
    refs = np.empty(0, np.int64)
    if widths is not None:
        refs, length, distance = repeats(image, argb)
    if len(refs):
        gone = np.zeros(len(argb) + 1, np.int64)
        np.add.at(gone, refs, 1)
        np.add.at(gone, refs + length, -1)
        keep = np.cumsum(gone[:-1]) == 0
        keep[refs] = True
        plain[~keep] = False
        plain[refs] = False
        of_width = widths[image[refs]]
        code = distance + 120
        for w in np.unique(of_width).tolist():
            table, own = distance_codes(w), of_width == w
            code[own] = np.where(distance[own] < len(table), table[np.minimum(distance[own], len(table) - 1)], code[own])
        length_symbol, length_extra, length_more = prefix_symbol(length)
        far_symbol, far_extra, far_more = prefix_symbol(code)
        symbol = symbol.copy()
        symbol[refs] = 256 + length_symbol
    sizes = [280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40]
    count = lambda where, of, size: np.bincount(image[where] * size + of, minlength=n * size).reshape(n, size)
    counts = [count(keep, symbol[keep], sizes[0])] + [count(plain, c[plain], 256) for c in (red, blue, alpha)]
    counts.append(count(refs, far_symbol, 40) if len(refs) else np.zeros((n, 40), np.int64))
    length_value, length_bits = _length_code_header()
    turned = reversed_bits(4)
    codes, spent = [], []
    for c in counts:
        single = (c > 0).sum(axis=1) <= 1
        one, many = np.flatnonzero(single), np.flatnonzero(~single)
        code, bits = np.zeros(c.shape, np.int64), np.zeros(c.shape, np.int64)
        # a simple code of one symbol takes no bits; each stream has either that or the lengths of a normal code
        out.put(who[one], 0b101 | (c[one].argmax(axis=1) << 3), 11)
        if len(many):
            bits[many] = code_lengths(c[many], 13)
            code[many] = codes_of(bits[many])
            out.put(who[many], length_value & ((1 << 32) - 1), 32)
            out.put(who[many], length_value >> 32, length_bits - 32)
            row, value, size = length_tokens(bits[many])
            out.put(who[many[row]], turned[value & 15] | ((value >> 4) << 4), size)
        codes.append(code), spent.append(bits)
    value = codes[0][image, np.where(keep, symbol, 0)].astype(np.uint64)
    size = spent[0][image, np.where(keep, symbol, 0)]
    for k, c in ((1, red), (2, blue), (3, alpha)):
        if spent[k].any():
            value |= np.where(plain, codes[k][image, c], 0).astype(np.uint64) << size.astype(np.uint64)
            size = size + np.where(plain, spent[k][image, c], 0)
    if len(refs):
        own, v, b = image[refs], value[refs], size[refs]
        for piece, bits in ((length_extra, length_more), (codes[4][own, far_symbol], spent[4][own, far_symbol]), (far_extra, far_more)):
            v, b = v | (piece.astype(np.uint64) << b.astype(np.uint64)), b + bits
        value[refs], size[refs] = v, b
    out.put(who[image[keep]], value[keep], size[keep])


def entropy(image: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Bits of each image's values (bytes) in an ideal code of single values."""
    counts = np.bincount(image * 256 + (value & 255), minlength=n * 256).reshape(n, 256)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(counts > 0, counts * np.log2(counts.sum(axis=1, keepdims=True) / np.maximum(counts, 1)), 0).sum(axis=1)


PLAIN, LEFT, TOP, GREEN, CROSS, PALETTE = range(6)


def encode(payloads: list[bytes], width: int = 64, cache_bits: int = 6) -> list[bytes]:
    """A lossless WebP file for each payload, its bytes as R, G, B of ``width`` pixels a row; payloads are whole rows of at most 8192 pixels.

    Each image gets the transform of the least estimated size: none, a predictor (left or top), subtracted green, a
    cross-colour factor or a palette of up to 256 colours, with small indices packed. Pixels that stand before in the
    image are back-references, others literals or in the colour cache. All images are coded at once.
    """
    sizes = np.array([len(p) // 3 for p in payloads], np.int64)
    if any(len(p) % (3 * width) or not p for p in payloads) or sizes.max(initial=0) > 8192 or sizes.max(initial=0) > 16384 * width:
        raise ValueError("payloads must be whole rows and at most 8192 pixels")
    n = len(payloads)
    rgb = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, width, 3).astype(np.int32)
    rows = sizes // width
    top_row = np.zeros(len(rgb), bool)
    top_row[np.cumsum(rows) - rows] = True
    row_of = np.repeat(np.arange(n, dtype=np.int64), rows)
    image = np.repeat(np.arange(n, dtype=np.int64), sizes)
    flat = rgb.reshape(-1, 3)
    left = np.concatenate((np.zeros_like(rgb[:, :1]), rgb[:, :-1]), axis=1)
    top = np.concatenate((np.zeros_like(rgb[:1]), rgb[:-1]))
    top[top_row] = left[top_row]
    left[:, 0] = top[:, 0]
    by_left, by_top = (rgb - left).reshape(-1, 3), (rgb - top).reshape(-1, 3)
    green = signed(flat[:, 1]).astype(np.float64)
    spread = np.bincount(image, green * green, minlength=n) + 1e-9
    factor = np.stack([np.clip(np.rint(32 * np.bincount(image, green * signed(flat[:, k]), minlength=n) / spread), -128, 127).astype(np.int64) for k in (0, 2)])
    crossed = [flat[:, k] - ((factor[j][image] * signed(flat[:, 1])) >> 5) for j, k in enumerate((0, 2))]
    bits = lambda *parts: sum(entropy(image, p, n) for p in parts)
    plain_green = bits(flat[:, 1])
    cost = np.stack([
        plain_green + bits(flat[:, 0], flat[:, 2]),
        bits(*by_left.T) + 60,
        bits(*by_top.T) + 60,
        plain_green + bits(flat[:, 0] - flat[:, 1], flat[:, 2] - flat[:, 1]) + 3,
        plain_green + bits(*crossed) + 60,
        np.full(n, np.inf),
    ])
    colour = (flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]).astype(np.int64)
    known, at = np.unique((image << 24) | colour, return_inverse=True)
    first = np.searchsorted(known, np.arange(n + 1, dtype=np.int64) << 24)
    index, colours = at - first[image], np.diff(first)
    few_colours = np.flatnonzero(colours <= 256)
    if len(few_colours):
        cost[PALETTE, few_colours] = entropy(image, np.where(colours[image] <= 256, index, 0), n)[few_colours] + 18 * colours[few_colours] + 300
    cost[PLAIN] *= 0.99  # a transform must be worth its work
    kind = cost.argmin(axis=0)

    out = Writer(n)
    everyone = np.arange(n, dtype=np.int64)
    out.put(everyone, SIGNATURE | ((width - 1) << 8) | ((rows - 1) << 22), 40)  # no alpha, version 0
    argb = (OPAQUE | colour).astype(np.uint32)
    three = lambda r, g, b, a=0: packed(np.stack([np.broadcast_to(a, np.shape(g)), r, g, b], axis=-1))
    for k, rest in ((LEFT, by_left), (TOP, by_top)):
        who = np.flatnonzero(kind == k)
        if len(who):
            out.put(who, 1 | (5 << 3), 6)  # one block of up to 128 pixels a side
            put_pixels(out, who, np.arange(len(who)), np.full(len(who), OPAQUE | (k << 8), np.uint32), None)
            own = kind[image] == k
            argb[own] = three(*rest[own].T)
    who = np.flatnonzero(kind == GREEN)
    if len(who):
        out.put(who, 1 | (2 << 1), 3)
        own = kind[image] == GREEN
        argb[own] = three(flat[own, 0] - flat[own, 1], flat[own, 1], flat[own, 2] - flat[own, 1], 255)
    who = np.flatnonzero(kind == CROSS)
    if len(who):
        out.put(who, 1 | (1 << 1) | (5 << 3), 6)
        put_pixels(out, who, np.arange(len(who)), three(0 * who, factor[1][who], factor[0][who], 255), None)
        own = kind[image] == CROSS
        argb[own] = three(crossed[0][own], flat[own, 1], crossed[1][own], 255)
    widths = np.full(n, width)
    who = np.flatnonzero(kind == PALETTE)
    pieces = None
    if len(who):
        out.put(who, 1 | (3 << 1) | ((colours[who] - 1) << 3), 11)
        table = np.concatenate([known[first[i] : first[i + 1]] & 0xFFFFFF for i in who])
        of = np.repeat(np.arange(len(who)), colours[who])
        begin = np.concatenate(([True], of[1:] != of[:-1]))
        each = np.stack([np.full(len(table), 255), table >> 16, (table >> 8) & 255, table & 255], axis=-1)
        each[1:] -= np.where(begin[1:, None], 0, each[:-1].copy())
        put_pixels(out, who, of, packed(each), None)
        cut = np.concatenate(([0], np.cumsum(sizes)))
        pieces = [argb[cut[i] : cut[i + 1]] for i in range(n)]
        for i in who.tolist():
            shift = palette_shift(int(colours[i]))
            per, size = 1 << shift, 8 >> shift
            own = index[cut[i] : cut[i + 1]].reshape(-1, width)
            own = np.pad(own, ((0, 0), (0, -width % per))).reshape(len(own), -1, per)
            pieces[i] = (OPAQUE | ((own << (np.arange(per) * size)).sum(axis=2) << 8)).astype(np.uint32).reshape(-1)
            widths[i] = (width + per - 1) // per
        argb = np.concatenate(pieces)
        image = np.repeat(everyone, [len(p) for p in pieces])
    out.put(everyone, 0, 1)  # no further transform
    put_pixels(out, everyone, image, argb, widths, cache_bits)
    return [simple_file(s) for s in out.streams()]


def piece(name: bytes, data: bytes) -> bytes:
    return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)


def simple_file(stream: bytes) -> bytes:
    body = b"WEBP" + piece(b"VP8L", stream)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def stacked(files: list[bytes], width: int, heights: list[int]) -> bytes:
    """One WebP file that shows simple ones below each other: a canvas on which each is a frame at its place, shown at once and kept. A single one stays as it is."""
    if len(files) == 1:
        return files[0]
    number = lambda x: int(x).to_bytes(3, "little")
    body = [b"WEBP", piece(b"VP8X", b"\x02\0\0\0" + number(width - 1) + number(sum(heights) - 1)), piece(b"ANIM", bytes(4) + b"\x01\0")]
    at = 0
    for f, h in zip(files, heights):
        body.append(piece(b"ANMF", number(0) + number(at // 2) + number(width - 1) + number(h - 1) + number(0) + b"\x02" + f[12:]))
        at += h
    data = b"".join(body)
    return b"RIFF" + len(data).to_bytes(4, "little") + data


def frames(image: bytes) -> list[bytes]:
    """The simple files of the frames of ``stacked``, from top to bottom; of a simple file that itself. Raises where frames don't fill the canvas row by row."""
    if len(image) < 30 or image[:4] != b"RIFF" or image[8:12] != b"WEBP" or int.from_bytes(image[4:8], "little") + 8 != len(image):
        raise ValueError("not a WebP file")
    if image[12:16] == b"VP8L":
        return [image]
    number = lambda at: int.from_bytes(image[at : at + 3], "little")
    found, at, row, canvas = [], 12, 0, number(27) + 1
    while at < len(image):
        name, size = image[at : at + 4], int.from_bytes(image[at + 4 : at + 8], "little")
        if name == b"ANMF":
            if number(at + 8) or 2 * number(at + 11) != row or number(at + 14) != number(24):
                raise ValueError("a frame isn't below the one before")
            row += number(at + 17) + 1
            body = b"WEBP" + image[at + 24 : at + 8 + size]
            found.append(b"RIFF" + len(body).to_bytes(4, "little") + body)
        at += 8 + size + (size & 1)
    if row != canvas:
        raise ValueError("frames don't fill the canvas")
    return found
