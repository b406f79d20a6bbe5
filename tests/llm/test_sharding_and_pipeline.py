import collections
import random
import zlib

import corpus_pipeline
import pytest
from marlpath.llm import frames, sharding
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def check(rows, docs, shards):
    want = sorted(str((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))) for r in docs.collect())
    assert want == sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def parts(rows, texts):
    """Shards of each text that has copies."""
    found = collections.defaultdict(set)
    for r in rows:
        found[texts[r["doc_id"]]].add(r["shard"])
    copies = collections.Counter(texts.values())
    return {t: len(s) for t, s in found.items() if copies[t] > 1}


def test_real_rows_stay_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_rows(docs, 6).collect()
    check(rows, docs, 6)
    assert set(parts(rows, {r["doc_id"]: r["text"] for r in docs.collect()}).values()) == {1}


def test_a_text_larger_than_a_shard(spark):
    texts = {i: "copy" if i < 300 else f"pair {i // 2}" if i < 500 else f"t{i}" for i in range(700)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.shard_rows(docs, 7).collect()
    check(rows, docs, 7)
    split = parts(rows, texts)
    assert split.pop("copy") <= 7 and sum(n > 1 for n in split.values()) <= 2


def test_large_groups_that_fit_stay_whole(spark):
    # groups of an eighth of a shard up to a whole one, beside pairs and single texts
    sizes = [100, 90, 70, 45, 30, 25, 20, 14] + [2] * 60
    texts, i = {}, 0
    for g, size in enumerate(sizes):
        for _ in range(size):
            texts[i] = f"group {g}"
            i += 1
    while i < 800:
        texts[i] = f"single {i}"
        i += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.shard_rows(docs, 8).collect()
    check(rows, docs, 8)
    split = parts(rows, texts)
    assert all(split[f"group {g}"] == 1 for g in range(8))
    # cut links as a share of all links in stars, against the least possible: none
    cut = sum(n - 1 for n in split.values()) / sum(n - 1 for n in sizes if n > 1)
    assert cut <= 0.01


def least_cut(sizes, room):
    """The least number of groups that stand in more than one shard, over all ways to fill shards with room for so many rows."""
    best = len(sizes)
    for whole in range(1 << len(sizes)):
        kept = sorted((n for k, n in enumerate(sizes) if whole >> k & 1), reverse=True)
        cut = len(sizes) - len(kept)
        if cut < best and fits(kept, list(room)):
            best = cut
    return best


def fits(kept, room):
    if not kept:
        return True
    for k in range(len(room)):
        if room[k] >= kept[0] and room[k] not in room[:k]:
            room[k] -= kept[0]
            if fits(kept[1:], room):
                return True
            room[k] += kept[0]
    return False


@pytest.mark.parametrize("seed", range(4))
def test_cut_groups_against_the_least_cut(spark, seed):
    # groups of equal texts and single rows in four shards, where some groups must be cut or none
    rng = random.Random(seed)
    sizes = [rng.randint(2, 9) for _ in range(9)]
    rows = [(f"group {k}", k) for k, n in enumerate(sizes) for _ in range(n)] + [(f"single {i}", -1) for i in range(rng.choice((0, 8)))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = sharding.shard_rows(df, shards=4).collect()
    n = len(rows)
    where: dict = {}
    for r in got:
        if rows[r["doc_id"]][1] >= 0:
            where.setdefault(rows[r["doc_id"]][1], set()).add(r["shard"])
    cut = sum(len(s) > 1 for s in where.values())
    least = least_cut(sizes, [n // 4 + (k < n % 4) for k in range(4)])
    assert least <= cut <= least + 2


def test_shards_do_not_depend_on_the_order_of_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df, shards in ((docs, 5), (odd, 3)):
        one = sorted(map(str, sharding.shard_rows(df, shards).collect()))
        assert one == sorted(map(str, sharding.shard_rows(df.repartition(5), shards).collect()))


def test_odd_few_and_no_rows(odd, none):
    check(sharding.shard_rows(odd, 3).collect(), odd, 3)
    check(sharding.shard_rows(odd, 24).collect(), odd, 24)
    assert sharding.shard_rows(none, 24).count() == 0


def test_no_python_in_the_plan(docs):
    text = sharding.shard_rows(docs, 4)._jdf.queryExecution().toString()
    assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


def test_gapless_ranks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"), "id")
    for keys in ([], ["k"]):
        own = collections.defaultdict(list)
        for r in frames.gapless_rank(df, keys, [F.col("id")], "rank", buckets=5).collect():
            own[tuple(r[k] for k in keys)].append(r["rank"])
        assert all(sorted(v) == list(range(len(v))) for v in own.values())
    assert frames.gapless_rank(df.limit(0), ["k"], [F.col("id")], "rank").count() == 0


def test_shared_folder_is_the_session_s(spark):
    assert frames.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_without_ids_by_either_join(spark, monkeypatch):
    docs, ids = spark.range(20).withColumnRenamed("id", "doc_id"), spark.range(0, 20, 2).withColumnRenamed("id", "doc_id")
    for most in (100, 3):
        monkeypatch.setattr(frames, "few", lambda keys, most=most: F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys)
        assert sorted(r[0] for r in frames.without_ids(docs, ids).collect()) == list(range(1, 20, 2))


def test_stages_in_order_and_each_takes_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = frames.pinned(stage(spark, docs, SF), name)
        rows = docs.collect()
        if k < 4:
            after = {r["doc_id"]: r for r in rows}
            assert docs.columns == columns and len(after) == len(rows) and after.keys() <= before.keys()
            gone = before.keys() - after.keys()
        if k == 0:
            own = [d for d in labels if d in before]
            assert sum((d in after) == bool(labels[d]) for d in own) / len(own) > 0.9
        if k == 1:
            assert len({r["text"] for r in rows}) == len(rows) and gone
        if k == 2:
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if k == 3:
            assert not any(i in r["text"] for i in items for r in rows) and all(after[d]["text"] == before[d]["text"] for d in after)
        if k == 4:
            assert {r["doc_id"] for r in rows} == before.keys()
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns
            kept = {(r["doc_id"], r["text"]) for r in out.collect()}
            assert kept <= {(r["doc_id"], r["text"]) for r in odd.collect()}
        else:
            assert out.where("doc_id is not null").select("doc_id").distinct().count() == 9
