import math

import numpy as np
import pytest
from marlpath.llm import blocks, covertree, hashing
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k) for i, v, k in rows], "vec_id long, embedding array<float>, label int")


def clustered(seed, n, d=24, hot=0):
    """Vectors around a few centres, the last ``hot`` of them all the same."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = (centres[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * rng.uniform(0.1, 1.0, (n, 1))).astype(np.float32)
    if hot:
        x[-hot:] = x[0]
    return x, rng.integers(0, 4, n)


def odd_rows(d):
    """Rows that take no part: null and zero vectors, null and non-finite components, other lengths, no id."""
    one = [1.0] * d
    return [(9001, None, 1), (9002, [0.0] * d, 1), (9003, [None, *one[1:]], 1), (9004, [NAN, *one[1:]], 1), (9005, [INF, *one[1:]], 1), (9006, [1.0, 2.0], 1), (9007, [], 1), (None, one, 1)]


def brute_nearest(x, ids, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        d = [(math.dist(x[i], x[j]), ids[j]) for j in range(len(x)) if ids[j] != q]
        out[q] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("hot", [0, 700])
def test_nearest_neighbours_against_brute_force(spark, hot):
    x, labels = clustered(1, 2000, hot=hot)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    df = frame(spark, rows + odd_rows(24)).withColumns({c: F.lit("!") for c in ("id", "code", "s", "top", "score")})
    want = brute_nearest(x.astype(float).tolist(), list(range(2000)), range(0, 2000, 100), 10)
    got: dict = {}
    for r in hashing.nearest(df, df.where("vec_id % 100 = 0").select("vec_id"), block=256).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want) >= 0.95 * 10 * len(want)
    for q, found in got.items():
        for score, v in found:
            assert math.isclose(score, math.dist(x[q].astype(float).tolist(), x[v].astype(float).tolist()), rel_tol=1e-12, abs_tol=0)
        assert found == sorted(found)


def test_every_code_within_the_radius_is_met_once(spark):
    # substrings of which a query's own block holds few: all pairs of codes, by plain Hamming distance
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (300, 4)).astype(np.uint16)
    codes[100:200] = codes[:100] ^ (1 << rng.integers(0, 16, (100, 4))).astype(np.uint16)
    import pyarrow as pa

    def batch(at):
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array([codes[i].tobytes() for i in at]), pa.array([[float(i)] for i in at])], ["id", "code", "vec"])

    for radius in (4, 11, 20, 31):
        met = []
        for s in range(4):
            for out in hashing.Block(s, batch(np.arange(300)), radius, 300)(batch(np.arange(0, 300, 3))):
                met += zip(out.column(0).to_pylist(), out.column(1).to_pylist())
        apart = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).sum(axis=2)
        assert len(met) == len(set(met))
        assert set(met) == {(i, j) for i in range(0, 300, 3) for j in range(300) if i != j and apart[i, j] <= radius}


def test_few_rows_and_outliers_get_all_they_can(spark):
    few = frame(spark, [(i, [float(i), 1.0, -1.0], 0) for i in range(6)])
    got = hashing.nearest(few, few.select("vec_id")).collect()
    assert len(got) == 30 and all(r["rank"] <= 5 for r in got)
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 3] == [2, 4, 1, 5, 0]
    x, _ = clustered(3, 600)
    x[0] = -40 * x[1]  # far from all others
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = {r["vec_id"] for r in hashing.nearest(df, df.where("vec_id = 0").select("vec_id"), share=0.5).collect()}
    assert len(got) == 10
    assert hashing.nearest(df.where("vec_id = 5"), df.where("vec_id = 5").select("vec_id")).count() == 0
    assert hashing.nearest(df.limit(0), df.select("vec_id")).count() == 0
    assert hashing.nearest(frame(spark, odd_rows(24)[:1]), df.select("vec_id")).count() == 0


def test_equal_rows_and_ties(spark):
    same = frame(spark, [(i, [1.0, 2.0, 3.0], 0) for i in range(30)] + [(4, [1.0, 2.0, 3.0], 0)])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hashing.nearest(same, same.where("vec_id in (0, 29)").select("vec_id")).collect())
    assert got == [(0, k, k, 0.0) for k in range(1, 11)] + [(29, k, k - 1, 0.0) for k in range(1, 11)]


def test_usable_vectors_keep_one_row_an_id(spark):
    rows = [(1, [2.0, 1.0], 3), (1, [1.0, 9.0], 2), (2, [5.0, 5.0], 1)]
    got = {r["id"]: r["vec"] for r in blocks.usable_vectors(frame(spark, rows + odd_rows(2)[:5]), "vec_id", "embedding", zero=False).collect()}
    assert got == {1: [1.0, 9.0], 2: [5.0, 5.0]}


def brute_negatives(rows, every=100):
    v = {}
    for i, x, k in rows:
        v[i] = (k, np.array([math.floor(256 * float(c)) for c in x], dtype=object))
    out = set()
    for a in (i for i in v if i % every == 0):
        score = {i: int((v[a][1] * x).sum()) for i, (_, x) in v.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][0] == v[a][0]][:5]:
            fits = [i for i in order if v[i][0] != v[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, r, n, score[p], score[n]) for r, n in enumerate(fits[:5], 1)}
    return out


def rows_of(df):
    return {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect()}


@pytest.mark.parametrize(("hot", "block"), [(0, 1024), (600, 64), (0, 100)])
def test_hard_negatives_are_those_of_brute_force(spark, hot, block):
    x, labels = clustered(5, 1500, d=12, hot=hot)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))]
    odd = [r for r in odd_rows(12) if r[0] != 9002] + [(7000, x[3].tolist(), None)]
    df = frame(spark, rows + odd).withColumns({c: F.lit("!") for c in ("id", "pivot", "part", "low", "score")})
    got = rows_of(covertree.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), block=block))
    assert got == brute_negatives(rows) and len(got) > 100


def test_hard_negatives_of_few_and_odd_rows(spark):
    none = frame(spark, [(0, [1.0, 0.0], 1)])
    assert covertree.hard_negatives(none, F.lit(True), F.col("label")).count() == 0
    assert covertree.hard_negatives(none.limit(0), F.lit(True), F.col("label")).count() == 0
    zero = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 2), (3, [-1.0, 0.5], 2)]
    assert rows_of(covertree.hard_negatives(frame(spark, zero), F.col("vec_id") % 100 == 0, F.col("label"))) == brute_negatives(zero) == {(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)}
    back = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.9, 0.0], 2)]  # a positive below zero has no window
    assert rows_of(covertree.hard_negatives(frame(spark, back), F.col("vec_id") % 100 == 0, F.col("label"))) == set()
    with pytest.raises(ArithmeticError):
        covertree.hard_negatives(frame(spark, [(0, [1e30, 0.0], 1), (1, [1.0, 0.0], 1)]), F.lit(True), F.col("label")).count()


def test_cover_trees_cover(spark):
    x, _ = clustered(7, 900, d=6, hot=200)
    top = float((x.astype(float) ** 2).sum(axis=1).max())
    points = covertree.augmented(x.astype(float), top)
    tree = covertree.CoverTree(points)
    for node in range(len(tree.centre)):
        assert (np.linalg.norm(points[tree.points[node]] - tree.centre[node], axis=1) <= tree.radius[node] + 1e-9).all()
        if tree.children[node] is not None:
            assert sorted(np.concatenate([tree.points[c] for c in tree.children[node]]).tolist()) == sorted(tree.points[node].tolist())
            assert all(tree.radius[c] <= tree.radius[node] / 2 + 1e-9 for c in tree.children[node])
    anchor = x[11].astype(float)
    norm = float(np.linalg.norm(anchor))
    least, most = covertree.bounds(anchor, norm, tree.centres, tree.radii, math.sqrt(top))
    for node in range(len(tree.centre)):
        s = x[tree.points[node]].astype(float) @ anchor
        assert least[node] <= s.min() and s.max() <= most[node]
