import math
import random
from itertools import combinations

import numpy as np
from marlpath.llm import neardup
from marlpath.llm.components import components
from marlpath.llm.wordstream import shingles, words


def brute(texts: dict[int, str], n=5):
    """Weighted Jaccard of all pairs, with exact document frequencies, in plain Python."""
    import re

    bags = {}
    for i, t in texts.items():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        grams = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
        bag: dict = {}
        for g in grams:
            bag[g] = bag.get(g, 0) + 1
        bags[i] = bag
    df: dict = {}
    for bag in bags.values():
        for g in bag:
            df[g] = df.get(g, 0) + 1
    weight = {i: {g: k * (1 + math.log((1 + len(texts)) / (1 + df[g]))) for g, k in bag.items()} for i, bag in bags.items()}
    out = {}
    for a, b in combinations(sorted(texts), 2):
        x, y = weight[a], weight[b]
        if x and y:
            both = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
            out[a, b] = both / (sum(x.values()) + sum(y.values()) - both)
        else:
            out[a, b] = float((texts[a] or "") == (texts[b] or ""))
        if (texts[a] or "") == (texts[b] or ""):
            out[a, b] = 1.0
    return out


def closure(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_classes_match_brute_force(spark, docs, make_prose):
    rng = random.Random(3)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k in range(12):  # a chain of ever more edited copies
        base = make_prose(rng, 150)
        for v in range(5):
            copy = list(base)
            for _ in range(v * 2):
                copy[rng.randrange(150)] = "edited"
            texts[10_000 + 10 * k + v] = " ".join(copy)
    same = brute(texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    sure = closure(texts, [p for p, s in same.items() if s >= 0.81])
    may = closure(texts, [p for p, s in same.items() if s >= 0.79])
    for i in texts:
        assert got[i] <= sure[i] or got[sure[i]] == got[i]
        assert may[got[i]] == may[i]
    assert len(set(got.values())) < len(texts)


def test_large_group_of_near_copies_is_one_class(spark, make_prose):
    rng = random.Random(5)
    base = make_prose(rng, 300)
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rng.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(make_prose(rng, 200))) for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), part_size=5000).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 400} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] >= 1000)


def test_pairs_in_large_buckets_of_a_shared_template_are_all_found(spark, make_prose):
    # all documents share 70 % of their weight, so that buckets hold nearly all of them; pairs within share 0.85
    rng = random.Random(9)
    template, texts = make_prose(rng, 1000), {}
    for pair in range(100):
        both = make_prose(rng, 31)
        for i in (pair, 1000 + pair):
            texts[i] = " ".join(template + both + make_prose(rng, 8))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for part_size in (1 << 20, 30_000):  # in one part and in several
        got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, rows=1, part_size=part_size).collect()}
        assert got == {i: i % 1000 for i in texts}


def test_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["class_id"], r["is_first"]) for r in rows}
    assert got[1] == (1, True) and got[2] == (1, False)
    assert got[3] == (3, True) and got[4] == (3, False)
    assert got[None] == (None, True) and got[6] == (6, True)
    kept = neardup.keep_first(odd)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "5", "6", "7", "8", "9", "None"])
    assert kept.columns == odd.columns
    assert neardup.near_duplicates(none).count() == 0


def test_rows_of_one_id_count_in_any_order(spark, make_prose):
    # ten ids with two texts each, and a near copy of either; the rows in both orders
    rng, rows = random.Random(17), []
    for i in range(10):
        for k in (0, 1):
            text = make_prose(rng, 120)
            rows += [(i, " ".join(text)), (100 + 2 * i + k, " ".join([*text[:60], "edited", *text[61:]]))]
    want = {j: i for i in range(10) for j in (i, 100 + 2 * i, 101 + 2 * i)}
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = neardup.near_duplicates(df).collect()
        assert len(got) == 40 and {r["doc_id"]: r["class_id"] for r in got} == want
        assert all(r["n_links"] == (1 if r["doc_id"] >= 100 else 2) and 0.8 <= r["similarity"] < 1 for r in got)
        kept = {r["doc_id"]: r["text"] for r in neardup.keep_first(df).collect()}
        assert kept == {i: min(t for j, t in rows if j == i) for i in range(10)}


def test_links_are_counted(spark, make_prose):
    rng = random.Random(18)
    base = make_prose(rng, 100)
    near = " ".join([*base[:50], "edited", *base[51:]])
    texts = {1: " ".join(base), 2: " ".join(base), 3: near, 4: " ".join(make_prose(rng, 100))}
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i]["n_links"] for i in (1, 2, 3, 4)] == [2, 1, 1, 0] and got[4]["similarity"] is None and got[2]["similarity"] == 1
    assert got[1]["similarity"] == 1 and 0.8 <= got[3]["similarity"] < 1


def test_samples_agree_as_often_as_documents_are_alike():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = h[:2000], h[500:]
    w = rng.uniform(1, 9, 3000)
    same = w[500:2000].sum() / w.sum()
    first = np.array([0, 2000])
    agree = []
    for k in range(400):
        s = neardup.icws(np.concatenate((a, b)), np.log(np.concatenate((w[:2000], w[500:]))).astype(np.float32), first, k)
        agree.append(s[0] == s[1])
    assert abs(np.mean(agree) - same) < 0.08


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, None)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 300]], "id long")
    got = {r["id"]: r["class_id"] for r in components(nodes, spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100 and got[300] == 300
    assert components(nodes.limit(0), spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_tell_words_apart():
    w = words(["Ab c é", None, "", "ab-C, É"])
    assert w.first.tolist() == [0, 3, 3, 3, 6] and (w.hash[:3] == w.hash[3:]).all()
    h, at = shingles(w, 2)
    assert at.tolist() == [0, 1, 3, 4] and (h[:2] == h[2:]).all()
    assert len(words([" ".join(f"w{i}" for i in range(200_000))]).hash) == 200_000
    assert len(set(words([" ".join(f"w{i}" for i in range(200_000))]).hash.tolist())) == 200_000
