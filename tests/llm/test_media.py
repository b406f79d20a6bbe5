import hashlib
import random
import zlib

import numpy as np
import pytest
from marlpath.llm import media, webp
from webp_writer import write


def smooth(rng, width, height):
    return [0xFF000000 | (((x * 3 + rng.randint(0, 2)) & 255) << 16) | (((y * 5 + x) & 255) << 8) | ((x + y + rng.randint(0, 1)) & 255) for y in range(height) for x in range(width)]


def noisy(rng, n):
    return [rng.randint(0, 2**32 - 1) if rng.random() < 0.3 else 0x11223344 + rng.randint(0, 3) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"cache_bits": 1}, {"cache_bits": 5}, {"copies": True}, {"copies": True, "cache_bits": 3}, {"tile_bits": 2}, {"tile_bits": 2, "copies": True, "cache_bits": 4}])
def test_entropy_coding(options):
    rng = random.Random(1)
    made, want = [], []
    for k, (w, h) in enumerate([(7, 9), (1, 1), (16, 3), (5, 13)]):
        p = noisy(rng, w * h) if k % 2 else (smooth(rng, w, h)[: w * h // 2] * 2 + smooth(rng, w, h))[: w * h]
        want.append(np.array(p, np.uint32).reshape(h, w))
        made.append(write(p, w, [], seed=k, **options))
    for got, w in zip(webp.decode(made), want):
        assert (got == w).all()
    assert all((webp.decode([m])[0] == w).all() for m, w in zip(made, want))


def four(p):
    return [(p >> s) & 255 for s in (24, 16, 8, 0)]


def join(c):
    return sum((int(x) & 255) << s for x, s in zip(c, (24, 16, 8, 0)))


def scalar_predict(mode, left, top, corner, right):
    """The format's predictions, one channel at a time, as its description words them."""
    l, t, tl, tr = map(four, (left, top, corner, right))
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        pl = sum(abs(b - c) for b, c in zip(t, tl))
        pt = sum(abs(a - c) for a, c in zip(l, tl))
        return left if pl < pt else top
    if mode == 12:
        return join([clamp(a + b - c) for a, b, c in zip(l, t, tl)])
    if mode == 13:
        return join([clamp(a + int((a - c) / 2)) for a, c in zip(avg(l, t), tl)])
    return join({0: [255, 0, 0, 0], 1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(l, tl), avg(t, tr))}[mode])


def residuals(p, width, modes, bits):
    out = []
    across = (width + (1 << bits) - 1) >> bits
    for i, now in enumerate(p):
        x, y = i % width, i // width
        if i == 0:
            guess = 0xFF000000
        elif y == 0:
            guess = p[i - 1]
        elif x == 0:
            guess = p[i - width]
        else:
            guess = scalar_predict(modes[(y >> bits) * across + (x >> bits)], p[i - 1], p[i - width], p[i - width - 1], p[i - width + 1])
        out.append(join([a - b for a, b in zip(four(now), four(guess))]))
    return out


def test_all_predictors():
    rng = random.Random(2)
    w, h, bits = 29, 18, 2
    p = smooth(rng, w, h)
    blocks = 8 * 5
    modes = [i % 14 for i in range(blocks)]
    f = write(residuals(p, w, modes, bits), w, [("predictor", bits, [0xFF000000 | (m << 8) for m in modes])])
    assert webp.decode([f])[0].reshape(-1).tolist() == p


def test_cross_colour_and_subtract_green():
    rng = random.Random(3)
    w, h, bits = 10, 9, 3
    p = noisy(rng, w * h)
    s8 = lambda v: v - 256 if v > 127 else v
    factors = [rng.randint(0, 2**24 - 1) | 0xFF000000 for _ in range(4)]
    coded = []
    for i, v in enumerate(p):
        a, r, g, b = four(v)
        f = factors[(i // w >> bits) * 2 + (i % w >> bits)]
        to_red, to_blue, red_blue = s8(f & 255), s8((f >> 8) & 255), s8((f >> 16) & 255)
        coded.append(join([a, r - ((to_red * s8(g)) >> 5), g, b - ((to_blue * s8(g)) >> 5) - ((red_blue * s8(r)) >> 5)]))
    crossed = write(coded, w, [("cross", bits, factors)])
    less = write([join([a, r - g, g, b - g]) for a, r, g, b in map(four, p)], w, [("green",)])
    for f in (crossed, less):
        assert webp.decode([f])[0].reshape(-1).tolist() == p


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    rng = random.Random(colours)
    w, h = 13, 6
    palette = [rng.randint(0, 2**32 - 1) for _ in range(colours)]
    index = [rng.randrange(colours) for _ in range(w * h)]
    shift = webp.palette_shift(colours)
    per, size = 1 << shift, 8 >> shift
    across = (w + per - 1) // per
    coded = [0xFF000000 | (sum(index[y * w + x * per + k] << (k * size) for k in range(per) if x * per + k < w) << 8) for y in range(h) for x in range(across)]
    f = write(coded, w, [("palette", palette)], coded_width=across)
    assert webp.decode([f])[0].reshape(-1).tolist() == [palette[i] for i in index]


def test_all_transforms_in_one_file():
    rng = random.Random(9)
    w, h, bits = 20, 11, 2
    p = smooth(rng, w, h)
    green = [join([a, r - g, g, b - g]) for a, r, g, b in map(four, p)]
    modes = [rng.randrange(14) for _ in range(5 * 3)]
    f = write(residuals(green, w, modes, bits), w, [("green",), ("predictor", bits, [m << 8 for m in modes])], cache_bits=4, copies=True, tile_bits=3)
    plain = write(p, w, [])
    got = webp.decode([f, plain])
    assert got[0].reshape(-1).tolist() == p and got[1].reshape(-1).tolist() == p


def test_damaged_files_raise():
    good = webp.encode([b"abc" * 64 * 4])[0]
    for bad in (b"", good[:30], b"RIFX" + good[4:], good[:20] + b"\x00" + good[21:], good[:16] + (40).to_bytes(4, "little") + good[20:60]):
        with pytest.raises(ValueError):
            webp.decode([bad])


@pytest.mark.parametrize("seed", range(4))
def test_encoder_round_trips(seed):
    rng = random.Random(seed)
    kinds = [lambda n: bytes(rng.choices(b"abc efg\n", k=n)), lambda n: rng.randbytes(n), lambda n: b" " * n, lambda n: (b"one two " * n)[:n]]
    payloads = [rng.choice(kinds)(192 * rng.randint(1, 64)) for _ in range(20)]
    for p, got in zip(payloads, webp.decode(webp.encode(payloads))):
        assert webp.channels(got)[..., 1:].astype(np.uint8).tobytes() == p and (got >> 24 == 255).all()


def first_transform(file):
    """0 predictor, 1 cross-colour, 2 subtracted green, 3 palette, None without one."""
    bits = int.from_bytes(file[20:28], "little") >> 40
    return (bits >> 1) & 3 if bits & 1 else None


def test_encoder_picks_each_transform_where_it_helps():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:40, :64]
    noise = lambda hi: rng.integers(0, hi, (40, 64))
    bytes_of = lambda r, g, b: (np.stack([r, g, b], axis=-1) & 255).astype(np.uint8).tobytes()
    wild = noise(256)
    images = {
        0: bytes_of(5 * x + noise(3), 3 * x + 1 + noise(2), x + noise(3)),
        2: bytes_of(wild + noise(2), wild, wild + 7 + noise(2)),
        1: bytes_of(((wild ^ 128) - 128) // 2 + noise(2), wild, noise(256)),
        3: bytes_of(*(rng.integers(0, 256, (3, 9))[:, noise(9)])),
        None: rng.bytes(192 * 40),
    }
    down = bytes_of(7 * y + 77 * x + noise(2), 5 * y + 31 * x * x + noise(2), y + noise(2))
    files = webp.encode([*images.values(), down])
    assert [first_transform(f) for f in files] == [*images, 0]
    for p, got in zip([*images.values(), down], webp.decode(files)):
        assert webp.channels(got)[..., 1:].astype(np.uint8).tobytes() == p


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_encoded_palettes(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 3)).astype(np.uint8)
    p = table[rng.integers(0, colours, 64 * 64)].tobytes()
    file = webp.encode([p])[0]
    assert first_transform(file) == 3 or colours in (1, 17, 200, 256)
    assert webp.channels(webp.decode([file])[0])[..., 1:].astype(np.uint8).tobytes() == p


def test_back_references_of_real_documents(docs):
    texts = [r["text"] or "" for r in docs.collect()]
    strips = [x for t in texts for x in media.to_images(media.padded(t)[0])]
    files = webp.encode(strips)
    kinds = [first_transform(f) for f in files]
    assert kinds.count(3) > 0
    pixels = webp.decode(files)
    held = 0
    for p in pixels:
        flat = p.reshape(-1)
        place, length, distance = webp.repeats(np.zeros(len(flat), np.int64), flat)
        held += len(place) > 0
        assert all((flat[a : a + n] == flat[a - d : a - d + n]).all() for a, n, d in zip(place, length, distance))
        assert (place[1:] >= place[:-1] + length[:-1]).all()
    assert held > 0.2 * len(files)
    twice = webp.encode([strips[0][: 192 * 8] * 2, strips[0][: 192 * 8]])
    assert len(twice[0]) < len(twice[1]) + 40


def test_a_long_text_is_one_file_of_frames():
    text = " ".join(f"word{i}" for i in range(20_000))
    payload, _ = media.padded(text)
    strips = media.to_images(payload)
    file = webp.stacked(webp.encode(strips), 64, [len(s) // 192 for s in strips])
    assert int.from_bytes(file[4:8], "little") + 8 == len(file) and file[12:16] == b"VP8X" and file[20] == 2
    assert int.from_bytes(file[24:27], "little") == 63 and int.from_bytes(file[27:30], "little") + 1 == len(payload) // 192
    own = webp.frames(file)
    assert len(own) == len(strips) and b"".join(webp.channels(p)[..., 1:].astype(np.uint8).tobytes() for p in webp.decode(own)) == payload
    for bad in (file[:-2], file[:12] + b"VP8Y" + file[16:40], file[:27] + b"\x01\0\0" + file[30:]):
        with pytest.raises(ValueError):
            webp.decode(webp.frames(bad))


def test_code_lengths_are_complete():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, (40, 90)) * (rng.random((40, 90)) < 0.3)
    counts[0], counts[1, :] = 0, 0
    counts[1, 5] = 7
    lengths = webp.code_lengths(counts, 13)
    for c, x in zip(counts, lengths):
        assert ((x > 0) == (c > 0)).all()
        if (c > 0).sum() > 1:
            assert (2.0 ** -x[x > 0]).sum() == 1


def test_media_of_odd_and_real_rows(docs, odd, none):
    for df in (odd, docs.limit(40)):
        rows = media.decode_features(media.encode_texts(df), pixels=True).collect()
        want = sorted(str((r["doc_id"], (r["text"] or "").encode())) for r in df.collect())
        assert sorted(str((r["doc_id"], bytes(r["pixels"])[: r["n_bytes"]])) for r in rows) == want
        for r in rows:
            p = bytes(r["pixels"])
            assert len(p) % 192 == 0 and p and set(p[r["n_bytes"] :]) <= {32} and len(p) - r["n_bytes"] < (192 if r["n_bytes"] else 193)
            assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:]) and r["payload_bytes"] == len(p)
    same = {r["doc_id"]: (r["media_sha256"], r["feature"]) for r in media.decode_features(media.encode_texts(odd)).collect()}
    assert same[1] == same[2] and same[3] == same[4]
    assert media.decode_features(media.encode_texts(none)).count() == 0
