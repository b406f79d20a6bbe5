import math
import random

import numpy as np
from marlpath.llm import labelled, quality, toxicity
from marlpath.llm.labelled import crc_of_id
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def held_out(spark, module, label, mod, rest):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = crc_of_id(F.col("doc_id")) % mod
    model = module.train(docs, labels, label, kept != rest)
    own = labels.where(kept == rest)
    rows = module.scores(docs.join(own.select("doc_id"), "doc_id", "left_semi"), model).join(own, "doc_id").collect()
    return np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_quality_on_held_out_documents(spark):
    score, label = held_out(spark, quality, "quality", 5, 0)
    assert auc(score, label) > 0.99 and ((score >= 0.3) == label).mean() > 0.98


def test_toxicity_on_held_out_documents(spark):
    # about two fifths of the small table's toxic labels are on texts without any toxic word
    score, label = held_out(spark, toxicity, "toxic", 4, 2)
    assert auc(score, label) > 0.8 and ((score >= 0.3) == label).mean() > 0.9


def test_misspelt_words_share_subwords(spark):
    rng = random.Random(0)
    plain = ["".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(plain, k=40) + (["idiotic", "worthless"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), "toxic", F.lit(True))
    bad, good = model.score([" ".join(rng.choices(plain, k=40) + ["idiotik", "worthles"]), " ".join(rng.choices(plain, k=40))])
    assert bad > 0.5 > good


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, None, 0), (5, 0, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.train(odd, labels, label, F.lit(True))
        rows = module.scores(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        by_id = {r["doc_id"]: r["score"] for r in rows}
        assert by_id[1] == by_id[2] and by_id[3] == by_id[4]
        assert module.scores(none, model).count() == 0
        module.train(none, labels.limit(0), label, F.lit(True))


def test_keep_good_keeps_whole_rows(odd):
    weight = np.zeros(quality.DIM)
    weight[quality.shape_ngrams("x")] = -10
    kept = quality.keep_good(odd, quality.Model(weight, 1.0))
    assert kept.columns == odd.columns and 8 not in {r["doc_id"] for r in kept.collect()} and kept.count() < odd.count()


def test_sample_is_bounded_and_stratified(spark):
    df = spark.createDataFrame([(i, f"t{i}", int(i % 50 == 0)) for i in range(3000)] + [(7, "again", 0)] * 5, "doc_id long, text string, quality int")

    def features(texts):
        return texts.select("id", F.lit(bytes(4)).alias("features"))

    s = labelled.labelled_sample(df, df, "quality", F.lit(True), 200, features)
    assert len(s.label) == 200 and s.label.sum() == 60 and s.shift < 0


def test_dual_coordinate_descent_solves_the_stated_problem():
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 40, 8)).astype(np.uint32) for _ in range(120)]
    y = np.array([int((f < 12).sum() >= 3) for f in x])
    c = 0.05
    w, b = quality.nb_support_vectors(x, y, c, 400)
    sums = [np.ones(quality.DIM), np.ones(quality.DIM)]
    for f, k in zip(x, y):
        sums[k][f] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    dense = np.zeros((120, 41))
    for i, f in enumerate(x):
        dense[i, f] = ratio[f]
    dense[:, 40] = 1
    sign = 2 * y - 1
    loss = lambda v: 0.5 * v @ v + c * np.maximum(0, 1 - sign * (dense @ v)).sum()
    v, best = np.zeros(41), np.inf
    for t in range(20000):  # subgradients with falling steps come near the least value from above
        v -= (v - c * dense.T @ (sign * (sign * (dense @ v) < 1))) / (t + 2)
        best = min(best, loss(v))
    found = np.append(np.where(ratio[:40] != 0, w[:40] / np.where(ratio[:40] == 0, 1, ratio[:40]), 0), b)
    assert best * (1 - 5e-3) < loss(found) < best * (1 + 1e-4)


def test_calibration_orders_and_centres():
    rng = np.random.default_rng(1)
    m = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * m - 1)))).astype(int)
    a, b = labelled.calibrate(m, y)
    assert abs(a - 1.5) < 0.2 and abs(b + 1) < 0.2


def test_samples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    made = lambda texts: texts.select("id", F.encode(F.rpad("text", 80, "y"), "UTF-8").alias("features"))
    sample = lambda **o: labelled.labelled_sample(docs, labels, "quality", F.lit(True), 40, made, **o)
    whole, part = sample(), sample(most_bytes=80 * 7 + 5)
    assert len(whole.features) == 40 and sorted(whole.label.tolist()) == [0] * 20 + [1] * 20
    assert len(part.features) == 7 and all((a == b).all() for a, b in zip(part.features, whole.features)) and len(sample(most_bytes=1).features) == 1


def test_embeddings_are_trained_as_one_by_one(monkeypatch):
    monkeypatch.setattr(toxicity, "DIM", 64)
    rng = np.random.default_rng(4)
    bags = [np.unique(rng.integers(0, 64, rng.integers(0, 9))) for _ in range(40)]
    label = rng.integers(0, 2, 40)
    weight, bias = toxicity.train_embeddings(bags, label, width=3, epochs=2)

    draw = np.random.default_rng(0)
    v = draw.normal(0, 0.02, (64, 3)).astype(np.float32).astype(float)
    w = draw.normal(0, 0.5, (2, 3)).astype(np.float32).astype(float)
    b, spent = [0.0, 0.0], [1e-8] * 64
    for _ in range(2):
        for i in draw.permutation(40):
            own, n = bags[i].tolist(), len(bags[i])
            if not n:
                continue
            mean = [sum(v[k][d] for k in own) / n for d in range(3)]
            z = [sum(w[c][d] * mean[d] for d in range(3)) + b[c] for c in (0, 1)]
            e = [math.exp(x) for x in z]
            p = [x / sum(e) for x in e]
            p[label[i]] -= 1  # the gradient of the softmax's log loss
            back = [sum(p[c] * w[c][d] for c in (0, 1)) for d in range(3)]
            for c in (0, 1):
                b[c] -= 0.05 * p[c]
                for d in range(3):
                    w[c][d] -= 0.05 * p[c] * mean[d]
            for k in own:
                spent[k] += (max(abs(x) for x in back) / n) ** 2
                for d in range(3):
                    v[k][d] -= 0.5 / n / math.sqrt(spent[k]) * back[d]
    want = [sum(v[k][d] * (w[1][d] - w[0][d]) for d in range(3)) for k in range(64)]
    assert np.allclose(weight, want, atol=2e-3) and abs(bias - (b[1] - b[0])) < 2e-3
