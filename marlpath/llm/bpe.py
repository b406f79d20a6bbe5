"""Exact token ids and token counts of public BPE vocabularies, many texts at a time, inside Spark tasks.

Both classes take the path of a ``tokenizers`` JSON file and give what ``tokenizers`` gives for it. They remember
the pieces between spaces, of which a corpus repeats most; the memory is cleared when it has ``most`` entries.
Texts outside the character range for which the splitting rule is written out here go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

#: The Latin letters and digits below U+0180 for which both splitting rules are written out.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿĀ-ſ"
DIGITS = "0-9²³¹¼-¾"
#: A character for which no rule is written out here: other scripts, control characters, odd white space.
OTHER = re.compile(r"[^\t\n\r -~¡-¬®-ňŊ-žİ]|[İ]")
#: White space at which a text may be cut whatever characters it has.
SPACES = re.compile(r"[ \t\n\r]+")
#: White space where cutting before a space could part one piece in two.
RUN = ("  ", " \n", "\n ", "\t", "\r")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 250_000):
        spec = json.loads(open(path, encoding="utf-8").read())
        byte_of = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.whole = Tokenizer.from_file(path)
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = _Memo(self._piece, most)

    def _piece(self, piece: str) -> bytes:
        core = self.encoding._core_bpe
        if piece.isascii() and piece.isalpha():
            return array("I", core.encode_single_piece(b" " + piece.encode())).tobytes()
        return array("I", core.encode_ordinary(" " + piece)).tobytes()

    def ids(self, text: str) -> bytes:
        """Null-free text to ids; special strings inside a text become their special ids, as the library does by default."""
        if "<|" in text and any(s in text for s in self.special) or OTHER.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if any(r in text for r in RUN):
            return array("I", self.encoding._core_bpe.encode_ordinary(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.encoding._core_bpe.encode_ordinary(first)).tobytes()
        return head + b"".join(map(self.memo.__getitem__, rest))


class WordCounter:
    """Token counts of a word-end BPE vocabulary, by the whole-token shortcut.

    ``single`` holds every string that encodes alone as one token. It is proved once, by running the merges on each
    vocabulary entry that ends a word, before any text is seen, and may be handed on to other counters. A pre-token
    found in it counts 1 without merging; only the others are merged, and their counts remembered.
    """

    def __init__(self, path: str, single: frozenset[str] | None = None, most: int = 500_000):
        spec = json.loads(open(path, encoding="utf-8").read())
        self.end = spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        stand_in = {b: c for c, b in byte_alphabet().items()}
        self.spelling = [stand_in[b] for b in range(256)]
        self.single = self._prove(spec["model"]["vocab"]) if single is None else single
        self.memo = _Memo(self._piece, most)
        self.words = _Memo(self._word, most // 2)
        self.odd = _Memo(lambda piece: len(self.whole.encode(piece, add_special_tokens=False).ids), most // 10)
        self.split = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")

    def _prove(self, vocab: dict[str, int]) -> frozenset[str]:
        byte_of = byte_alphabet()
        found = set()
        for entry in vocab:
            stem = entry[: -len(self.end)] if entry.endswith(self.end) else ""
            if stem and all(c in byte_of for c in stem) and self.merged(stem) == 1:
                try:
                    found.add(bytes(byte_of[c] for c in stem).decode())
                except UnicodeDecodeError:
                    pass  # part of a character: no text has it as a pre-token
        return frozenset(found)

    def merged(self, stem: str) -> int:
        """Tokens left when all merges are done on one spelled pre-token."""
        return len(self.model.tokenize(stem))

    def _word(self, word: str) -> int:
        if word in self.single:
            return 1
        return self.merged("".join(self.spelling[b] for b in word.encode()))

    def _piece(self, piece: str) -> int:
        low = piece.lower()
        if low in self.single and low.isalpha():
            return 1
        return sum(map(self.words.__getitem__, self.split.findall(low)))

    def count(self, text: str) -> int:
        """Tokens of a null-free text; pieces between white space never share a token, so only pieces with odd characters go to the library."""
        if "<|" in text and any(s in text for s in self.special):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        if OTHER.search(text):
            return sum((self.odd if OTHER.search(p) else self.memo)[p] for p in SPACES.split(text) if p)
        return sum(map(self.memo.__getitem__, text.split()))


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=2)
def word_counter(path: str, single: frozenset[str] | None = None) -> WordCounter:
    return WordCounter(path, single)
