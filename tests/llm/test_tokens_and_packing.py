import random
import zlib
from array import array

import public_tokenizers
import pytest
from marlpath.llm import bpe, packing, token_counts
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "'S IT'S I'll", "a  b\n\n c\td ", "ŉİı K ſ", "x<|endoftext|>y", "<|startoftext|> A", "日本 text", "é combining", "1234 ½ ²x", "--'s''t !!a's", "\xa0nb\x85x", "a\r\nb", "\x1cfs", " lead", "trail ", "  ", "ǅ"]


def test_same_ids_and_counts_as_the_library(docs):
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for text in ODD + [r["text"] for r in docs.select("text").limit(60).collect()]:
        assert bpe.byte_bpe(BYTE).ids(text) == array("I", byte.encode(text, add_special_tokens=False).ids).tobytes()
        assert bpe.word_counter(WORD).count(text) == len(word.encode(text, add_special_tokens=False).ids)


def test_shortcut_strings_are_one_token_each():
    word = Tokenizer.from_file(WORD)
    for s in sorted(bpe.word_counter(WORD).single)[::97]:
        assert len(word.encode(s, add_special_tokens=False).ids) == 1


def test_a_full_memory_is_cleared():
    small = bpe.ByteBpe(BYTE, most=3)
    text = " ".join(f"w{i}" for i in range(50))
    assert small.ids(text) == bpe.byte_bpe(BYTE).ids(text) and len(small.memo) <= 3


def test_counts_of_odd_rows(odd, none):
    word = Tokenizer.from_file(WORD)
    got = token_counts.token_counts(odd, WORD, limit=3).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(word.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert sorted(map(str, [(*w, w[2] > 3) for w in want])) == sorted(map(str, [tuple(r) for r in got]))
    assert token_counts.token_counts(none, WORD).count() == 0


@pytest.mark.parametrize("n, cap, pieces", [(1, 4, [(0, 1)]), (4, 4, [(0, 4)]), (5, 4, [(0, 1), (1, 4)]), (8, 4, [(0, 4), (4, 4)])])
def test_only_the_first_piece_is_short(n, cap, pieces):
    assert packing.cut(n, cap) == pieces


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_wastes_little(seed):
    import random

    rng = random.Random(seed)
    counts: dict[int, int] = {}
    for _ in range(3000):
        n = min(100, max(1, int(rng.lognormvariate(3, 1))))
        counts[n] = counts.get(n, 0) + 1
    used: dict[int, int] = {}
    bins = 0
    for mix, times in packing.best_two_fit(counts, 100):
        assert sum(mix) <= 100 and times > 0
        bins += times
        for n in mix:
            used[n] = used.get(n, 0) + times
    assert used == counts
    least = -(-sum(n * k for n, k in counts.items()) // 100)
    assert bins <= least + 2


def test_two_smaller_pieces_replace_the_smallest():
    # greedy fills 10 with 6 and 3; 2 and 2 fill the gap that 3 leaves exactly
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ([6, 2, 2], 1)


def test_lengths_outside_the_capacity_raise():
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def check(packed, docs, capacity):
    byte = Tokenizer.from_file(BYTE)
    want = []
    for r in docs.collect():
        ids = [*byte.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(str(r["doc_id"]), k, s, n, zlib.crc32(array("I", ids[s : s + n]).tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), capacity))]
    rows = packed.collect()
    assert sorted(want) == sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(w[3] for w in want)


def test_pack_on_real_and_odd_rows(docs, odd, none):
    bins, tokens = check(packing.pack(packing.token_pieces(docs, BYTE, 2048)), docs, 2048)
    assert bins <= -(-tokens // 2048) + 2
    check(packing.pack(packing.token_pieces(odd, BYTE, 256, keep_ids=False), 256), odd, 256)
    assert packing.pack(packing.token_pieces(none, BYTE)).count() == 0


def test_sequences_hold_the_ids(odd):
    packed = packing.pack(packing.token_pieces(odd, BYTE, 512), 512)
    parts = packed.orderBy("sequence_id", "offset").collect()
    for r in packing.sequences(packed).collect():
        own = b"".join(bytes(p["ids"]) for p in parts if p["sequence_id"] == r["sequence_id"])
        assert bytes(r["ids"]) == own and len(own) == 4 * r["n_tokens"]


def test_odd_characters_go_to_the_library_by_the_piece():
    counter = bpe.word_counter(WORD)
    rng = random.Random(1)
    odd = [chr(c) for c in (0x2019, 0x201C, 0x2013, 0xA0, 0x2003, 0x2028, 0x85, 0x1C, 0x0B, 0x300, 0x3A3, 0x3C3, 0x130, 0xAD, 0x200B, 0x1F600, 0x4E2D, 0xFB01, 0x345, 0x0, 0x5D0, 0xE33)]
    base = [*"abcXYZ 019.,'!-&<|>\n\t\r  ", "the ", "'s", "don't ", " word", "Zürich ", "él "]
    for _ in range(3000):
        text = "".join(rng.choice(odd if rng.random() < 0.25 else base) for _ in range(rng.randint(1, 25)))
        assert counter.count(text) == len(counter.whole.encode(text, add_special_tokens=False).ids)
