import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from marlpath.llm import spelling


def brute_counts(rows, least=7, drop=31):
    total: Counter = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= 2}


def edits(w, letters):
    for k in range(len(w) + 1):
        for c in letters:
            yield w[:k] + c + w[k:]
            if k < len(w):
                yield w[:k] + c + w[k + 1 :]
        if k < len(w):
            yield w[:k] + w[k + 1 :]


def brute_variants(n):
    letters = sorted({c for w in n for c in w})
    near, form = {}, {}
    for w in n:
        near[w] = {v for v in edits(w, letters) if v in n and v != w}
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_of_documents_as_by_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(1000 + i, "Größenordnung Éclair×éclairs÷Éclairs ÑANDÚES ñandúes garçonnière GARÇONNIÈRE " * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = spelling.word_counts(df)
    want = brute_counts(rows)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    assert rows_of(spelling.variants(counts)) == brute_variants(want)


def test_variants_in_many_small_blocks(spark):
    # words of few letters, so that very many are near one another and many points are equal
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.choice((7, 7, 8, 9)))) for _ in range(1500)} | {"a" * n for n in (7, 8, 9, 300, 301, 302, 400)} | {"b" * 299 + "c", "é" * 7, "é" * 6 + "è"}
    n = {w: rng.choice((2, 3, 25, 40, 400, 5000)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute_variants(n)
    for block, sample in ((1 << 16, 1 << 16), (40, 1 << 16), (100, 50)):
        assert rows_of(spelling.variants(df, block=block, sample=sample)) == want


def test_forms_are_followed_to_the_last(spark):
    chain = {"abcdefg"[:k] + "x" * (10 - k): 2 * 10**k for k in range(8)}
    got = {w: (f, r) for w, f, r, *_ in rows_of(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")))}
    assert all(r == "abcdefgxxx" for _, r in got.values()) and got["xxxxxxxxxx"][0] == "axxxxxxxxx" and got["abcdefgxxx"][0] is None


def test_ties_go_to_the_smaller_word(spark):
    n = {"zettels": 2, "zettelz": 2, "bettels": 50, "zettela": 50}
    got = {w: f for w, f, *_ in rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))}
    assert got == {"zettels": "bettels", "zettelz": "zettela", "bettels": None, "zettela": None}


def test_words_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    counts = spelling.word_counts(odd, least=4)
    assert {r["word"]: r["n"] for r in counts.collect()} == brute_counts(rows, least=4)
    assert rows_of(spelling.variants(counts)) == brute_variants(brute_counts(rows, least=4))
    assert spelling.word_counts(none).count() == 0 and spelling.variants(spelling.word_counts(none)).count() == 0
    repeated = spark.createDataFrame([("abcdefg", 2), ("abcdefg", 3), (None, 9), ("abcdefh", 50)], "word string, n long")
    assert rows_of(spelling.variants(repeated)) == {("abcdefg", "abcdefh", "abcdefh", 5, 1, 50), ("abcdefh", None, "abcdefh", 50, 1, None)}


def test_boxes_and_trees_lose_no_near_point():
    rng = np.random.default_rng(1)
    own = spelling.Spelled(["".join(rng.choice(list("abcdeé"), 8)) for _ in range(3000)])
    boxes = spelling.Boxes(own.points[:500], 16)
    at, box = boxes.within(own.points, 0)
    assert sorted(at.tolist()) == list(range(3000)) and len(set(box.tolist())) > 8
    tree = spelling.Tree(own.points)
    reach = np.full(200, 2)
    got = {(i, j) for a, b in tree.near(own.points[:200], reach) for i, j in zip(a.tolist(), b.tolist())}
    d = np.bitwise_count(own.points[:200, None] ^ own.points[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= 2))))
