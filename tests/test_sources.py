"""Sources and queues against plain loops."""

import random
import re

import pytest
from marlpath.operators import match, natural, pacing
from marlpath.sources import records, sitemaps
from marlpath.streaming import queue
from pyspark.sql import functions as F


def test_candidates_are_those_of_comparing_all(spark):
    rng = random.Random(2)
    words = ["red", "blue", "big", "box", "duel", "gold", "ring", "star"]
    names = {}
    for i in range(400):
        names[i] = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2))}
    titles = {t: " ".join(rng.sample(words, rng.randint(1, 4))) for t in range(12)} | {12: "red red box", 13: "nothing known", 14: ""}

    def overlap(title, name):
        own, left = title.split(), name.split()
        return sum(1 for w in left if w in own)

    want = set()
    for t, title in titles.items():
        found = []
        for i, own in names.items():
            best = max(overlap(title, n) for n in own)
            if best:
                found.append((title not in own, -best, i))
        want |= {(t, i, not inexact, -best, k) for k, (inexact, best, i) in enumerate(sorted(found)[:20], 1)}
    df = spark.createDataFrame(list(titles.items()), "title_id long, title string")
    known = df.select("title_id", F.array("title").alias("variants"), match.words_of(F.col("title")).alias("words"))
    held = spark.createDataFrame([(i, n) for i, own in names.items() for n in own], "item_id long, name string")
    got = match.title_candidates(known, held, most=20).select("title_id", "item_id", "exact", "overlap", "rank")
    assert {tuple(r) for r in got.collect()} == want


def test_names_like_finds_words_in_order(spark):
    rng = random.Random(3)
    parts = ["cat", "catan", "an", "x", "azul", "zu", "ticket", "ride"]
    names = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 3))).title(), rng.choice([None, 1999, 2001, 2020])) for i in range(300)]
    queries = [(q, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 2)))) for q in range(15)] + [(15, "zzz cat"), (16, ""), (17, "x")]
    want = set()
    for q, text in queries:
        hits = []
        for i, name, year in set(names):
            at, low = 0, name.lower()
            for w in text.split():
                at = low.find(w, at)
                if at < 0:
                    break
                at += len(w)
            if text and at >= 0:
                hits.append((low != text, -(year or 0), -i))
        want |= {(q, -i, k) for k, (_, _, i) in enumerate(sorted(hits)[:7], 1)}
    wanted = spark.createDataFrame([(q, t, t) for q, t in queries], "query_id long, query string, folded string")
    got = match.names_like(wanted, spark.createDataFrame(names, "external_id long, name string, year int"), most=7)
    assert {tuple(r) for r in got.select("query_id", "external_id", "pos").collect()} == want


XML = """<?xml version="1.0"?><items><item id="7" type="boardgame">
<name value="Caf&amp;eacute; &amp;amp;amp; T&#233;" sortindex="1" type="primary"/><name type="alternate" value=" Two "/><name type="alternate" value=""/>
<thumbnail>https://t</thumbnail><minplayers value="2"/><maxplayers value="x"/><playingtime value="30"/><maxplaytime value="45"/>
<link inbound="true" value="Base" id="9" type="boardgameexpansion"/><link type="boardgamecategory" id="0" value="none"/><link type="boardgamecategory" id="3" value="A &lt; B"/>
<statistics><ratings><average value="7.25"/></ratings></statistics></item></items>"""


def test_records_in_xml(spark):
    docs = spark.createDataFrame([(XML,), (XML[:-40],), ("<items/>",), ("<items><item type='x'/></items>",), (None,), ("no xml",)], "xml string")
    got = records.things(docs).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["external_id"], r["kind"], r["name"], r["alternate_names"]) == (7, "boardgame", "Café & Té", ["Two"])
    assert (r["image"], r["min_players"], r["max_players"], r["min_minutes"], r["max_minutes"], r["rating"], r["weight"]) == ("https://t", 2, None, 30, 45, 7.25, None)
    assert [tuple(k) for k in r["links"]] == [(0, "boardgameexpansion", 9, "Base", True), (2, "boardgamecategory", 3, "A < B", False)]


def test_addresses_of_a_map_do_not_carry_its_text(spark):
    df = spark.createDataFrame([("https://a.mx/sitemap.xml", "<sitemap/><loc>/products/a</loc><loc>/products/b</loc>"), ("https://a.mx/none.xml", None)], "url string, text string")
    found = sitemaps.entries(df)
    assert [(r["pos"], r["target"], r["is_map"]) for r in found.orderBy("pos").collect()] == [(0, "https://a.mx/products/a", False), (1, "https://a.mx/products/b", False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "<sitemap" in plan and plan.index("Generate posexplode") < plan.index("<sitemap")  # the root stands first: the map is asked below


def test_sitemaps_with_cycles_and_limits(spark):
    at = "https://www.shop.mx"
    docs = {
        f"{at}/sitemap.xml": "<sitemapindex><sitemap><loc>/sitemap-a.xml</loc></sitemap><sitemap><loc>https://other.mx/sitemap.xml</loc></sitemap><loc>/products/r</loc></sitemapindex>",
        f"{at}/sitemap-a.xml": f"<sitemap/><loc>{at}/sitemap-b.xml</loc><loc>{at}/products/a?x=1</loc><loc>{at}/about</loc><loc>{at}/sitemap.xml</loc>",
        f"{at}/sitemap-b.xml": "<sitemap/><loc>/sitemap-a.xml</loc><loc><![CDATA[/products/b]]></loc><loc>/products/a</loc><loc>/products/c</loc>",
        f"{at}/product-sitemap.xml": "<loc>/products/d</loc><loc>https://other.mx/products/e</loc>",
    }
    stores = spark.createDataFrame([(1, f"{at}/inicio"), (2, "https://empty.mx")], "store_id long, store_url string")
    df = spark.createDataFrame(list(docs.items()), "url string, text string")
    read = lambda **o: [(r["store_id"], r["url"].rsplit("/", 1)[1]) for r in sitemaps.product_addresses(stores, df, **o).orderBy("store_id", "pos").collect()]
    assert read() == [(1, x) for x in ("r", "a", "d", "b", "c")]
    assert read(limit=3) == [(1, x) for x in ("r", "a", "d")] and read(limit=2) == [(1, "r"), (1, "a")]
    assert sitemaps.product_addresses(stores, df.limit(0)).count() == 0


def paced_in_turn(requests):
    """Each host's requests one after the other, as a clock would have them."""
    ready, cooling, out = {}, {}, {}
    for host, i, at, throttled, after, jitter in sorted(requests, key=lambda r: (r[0], r[2], r[1])):
        paced, cold = ready.get(host, 0), cooling.get(host, 0)
        start = max(at, paced, cold)
        reason = "" if start == at else "cooldown" if cold >= paced and cold > at else "pacing"
        ready[host] = start + 2_000_000 + jitter
        if throttled:
            cooling[host] = max(cold, start + min(300_000_000, 30_000_000 if after is None else max(0, after)))
        out[i] = (start, start - at, reason)
    return out


def test_pacing_is_that_of_a_clock(spark):
    rng = random.Random(5)
    requests = [(f"h{rng.randrange(3)}", i, rng.randrange(400) * 500_000, rng.random() < 0.15, rng.choice([None, 0, 5_000_000, 900_000_000, -1]), rng.randrange(1_000_000)) for i in range(600)]
    df = spark.createDataFrame(requests, "host string, id long, wanted_at long, throttled boolean, retry_after long, jitter long")
    got = pacing.paced(df, F.col("jitter"), F.floor(F.col("wanted_at") / 20_000_000)).collect()
    assert {r["id"]: (r["starts_at"], r["delay"], r["reason"]) for r in got} == paced_in_turn(requests)
    assert pacing.paced(df.limit(0), F.col("jitter"), F.lit(0)).count() == 0


def test_order_of_shown_grids(spark):
    values = ["item 10", "Ítem 2", "item 2b", "", "10", "9.5", "-3", None, "1e2", "ITEM 1", "zebra"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string")
    up = [r["value"] for r in df.orderBy(*natural.shown_order(F.col("value")), "id").collect()]
    assert up == ["-3", "9.5", "10", "1e2", "ITEM 1", "Ítem 2", "item 2b", "item 10", "zebra", "", None]
    down = [r["value"] for r in df.orderBy(*natural.shown_order(F.col("value"), True), F.desc("id")).collect()]
    assert down == up[::-1]


def test_attempts_of_many_parts_have_ids_of_their_own(spark, tmp_path):
    from marlpath.plans.source_queries import queue_state, queue_transitions

    keys = [13, 26, 1_000_013, 1_000_026, 2_000_013, 2_000_026]  # a second attempt of one would be the first of another at a distance of a million
    spark.createDataFrame([(k, k % 50) for k in keys], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    _, outcomes = queue_state(spark, str(tmp_path))
    ids = [r["attempt_id"] for r in outcomes.collect()]
    assert len(ids) == len(set(ids))
    shown = sorted(r["id"] for r in queue_transitions(spark, str(tmp_path)).where("kind = 'attempt'").collect())
    assert shown == sorted(keys + [k + 1_000_000 for k in keys if k % 13 == 0])


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from marlpath.plans.source_queries import queue_state

    first, outcomes = queue_state(spark, "/root/testdata/sf0.001")
    state = queue.QueueState(spark, str(tmp_path / "state"))
    state.write(0, first)
    folder = str(tmp_path / "in")
    outcomes.where("attempt_id < 1000000").coalesce(1).write.parquet(folder)
    read = lambda: spark.readStream.schema(outcomes.schema).parquet(folder)
    state.run(read(), str(tmp_path / "checkpoint")).awaitTermination()
    got = {n: sorted(map(str, t.collect())) for n, t in state.read(1).items()}
    state.step(outcomes.where("attempt_id < 1000000"), 0)  # the same batch again, as after a lost driver
    assert {n: sorted(map(str, t.collect())) for n, t in state.read(1).items()} == got
    outcomes.where("attempt_id >= 1000000").coalesce(1).write.mode("append").parquet(folder)
    state.run(read(), str(tmp_path / "checkpoint")).awaitTermination()
    late = state.read(2)["attempts"].where("id >= 1000000")
    assert {r["status"] for r in late.collect()} == {"lease_lost", "failed"}  # leases that the first batch's outcomes ended, and those of which it had a wrong token
    whole = queue.transitions(first, outcomes)
    again = state.read(2)
    assert sorted(map(str, whole["listings"].collect())) == sorted(map(str, again["listings"].collect()))


@pytest.mark.parametrize("text, decoded", [("a &amp;amp; b", "a & b"), ("&amp;amp;amp;amp;", "&amp;"), ("&#x41;&nbsp;", "A\xa0"), ("plain", "plain"), ("&unknown;", "&unknown;")])
def test_entities_are_decoded_three_times(text, decoded):
    assert records.decoded_text(text) == decoded


@pytest.mark.parametrize("made", ["pages", "texts", "records"])
def test_work_made_of_a_narrow_table_is_dealt_over_tasks(spark, made):
    from marlpath.plans import import_queries, kernel_queries, offer_queries

    sf = "/root/testdata/sf0.01"  # 2,000 parts in one row group
    of = {"pages": offer_queries.told_pages, "texts": lambda *a: kernel_queries.dealt(*a, [("a",), ("b",)]), "records": import_queries.record_documents}[made](spark, sf)
    sizes = of.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 1000
    if made == "records":  # and XML is not parsed before it is dealt
        plan = records.things(of)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.rindex("from_xml") < plan.rindex("RepartitionByExpression") if "from_xml" in plan else plan.rindex("xmltostructs") < plan.rindex("RepartitionByExpression")


def test_equal_lookups_are_ranked_once(spark):
    wanted = spark.createDataFrame([(i, "Red Box", "red box", "c" if i % 2 else None) for i in range(6)], "query_id long, query string, folded string, context string")
    searches = spark.sql("select 'red box::cover-context:c' as key, 'ai' as kind, 7L as external_id, 1 as result_rank, timestamp'2020-01-01' as updated_at union all select 'red box', 'plain', 8L, 1, timestamp'2020-01-01'")
    names = spark.createDataFrame([(9, "red big box", 1)], "external_id long, name string, year int")
    found = match.search_cascade(wanted, searches, names, names.limit(0))
    got = {(r["query_id"], r["external_id"]): (r["level"], r["verified"], r["rank"]) for r in found.collect()}
    assert got == {(i, e): v for i in range(6) for e, v in ((7, (1, True, 1) if i % 2 else (2, False, 1)), (8, (4, False, 2)), (9, (5, False, 3)))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # the root stands first: ranks are given out to the lookups, not made for each


def cascade_of_loops(wanted, searches, cached, things):
    """search_cascade in plain loops; names are looked for word by word."""
    mark, ids, out = "::cover-context:", {}, []
    for i, *own in wanted:
        ids.setdefault(tuple(own), []).append(i)
    asked = {own: min((i for i in own_ids if i is not None), default=None) for own, own_ids in ids.items()}
    best = {}
    for (query, folded, context), i in asked.items():
        own = None if context is None else folded + mark + context
        hits = [(1, 0, r, e) for k, kind, e, r, _ in searches if kind == "ai" and k == own]
        hits += [(2, -t, r, e) for k, kind, e, r, t in searches if kind == "ai" and mark in k and k.split(mark)[0] == folded and k != own]
        hits += [({"ai": 3, "plain": 4}[kind], 0, r, e) for k, kind, e, r, _ in searches if k == folded]
        for level, names in ((5, cached), (6, things)):
            like = sorted((n != query.lower(), -y, -e) for e, n, y in set(names) if re.search(".*".join(folded.split()), n))
            hits += [(level, 0, at, -e) for at, (_, _, e) in enumerate(like[:20], 1)]
        for *m, e in hits:
            if e > 0:
                best.setdefault(i, {})[e] = min(best.get(i, {}).get(e, [9]), m)
    for own, i in asked.items():
        order = sorted((*m, e) for e, m in best.get(i, {}).items()) if i is not None else []
        out += [(member, e, m, m == 1, at) for at, (m, _, _, e) in enumerate(order, 1) for member in ids[own]]
    return sorted(map(str, out))


def made_cascade(spark, wanted, searches, cached, things):
    from datetime import UTC, datetime

    name = "external_id long, name string, year int"
    return match.search_cascade(
        spark.createDataFrame(wanted, "query_id long, query string, folded string, context string"),
        spark.createDataFrame([(*s[:4], datetime.fromtimestamp(s[4], UTC)) for s in searches], "key string, kind string, external_id long, result_rank int, updated_at timestamp"),
        spark.createDataFrame(cached, name), spark.createDataFrame(things, name),
    )


@pytest.mark.parametrize("shared_ids", [False, True])
def test_caches_are_ranked_as_by_loops(spark, monkeypatch, shared_ids):
    monkeypatch.setattr(match, "BLOCK", 4)
    monkeypatch.setattr(match, "GIVEN", 3)
    rng = random.Random(5)
    names, contexts = ["red box", "red big box", "gold ring", "duel"], ["a", "b", None]
    wanted = [(i, n.title(), n, rng.choice(contexts)) for i in range(30) for n in [rng.choice(names)]] + [(None, "Duel", "duel", "a"), (None, "No", "no", None)]
    wanted += [wanted[3], (7, "Red Box", "red box", "a"), (2, "Duel", "duel", "b")] if shared_ids else [wanted[3], (90, "red BOX", "red box", "a"), (91, "Red", "red", None), (92, "ring", "ring", "a")]
    context = lambda: rng.choice(["", "::cover-context:a", "::cover-context:b", "::cover-context:c"])
    searches = [(rng.choice(names) + context(), "ai", rng.randint(-1, 60), rng.randint(1, 3), rng.randint(0, 5)) for _ in range(120)]
    searches += [(rng.choice(names), "plain", rng.randint(-1, 90), rng.randint(1, 3), rng.randint(0, 5)) for _ in range(60)] + searches[:9]
    cached, things = ([(rng.randint(1, 150), rng.choice(names), rng.randint(1990, 2020)) for _ in range(40)] for _ in range(2))
    got = made_cascade(spark, wanted, searches, cached, things)
    assert sorted(str(tuple(r)) for r in got.collect()) == cascade_of_loops(wanted, searches, cached, things)


def shuffled_rows(df) -> int:
    """The rows that the exchanges of a frame's last run wrote."""

    def of(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            return of(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(of(node.children().apply(i)) for i in range(node.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_hits_are_not_shuffled_for_each_lookup(spark):
    lookups, hits = 60, 1500
    wanted = [(i, "Red Box", "red box", f"c{i}") for i in range(lookups)]
    searches = [(f"red box::cover-context:c{e % lookups}" if e % 3 else "red box", "ai" if e % 2 else "plain", e, 1, e % 7) for e in range(1, hits)]
    found = made_cascade(spark, wanted, searches, [], [])
    assert len(found.collect()) > lookups * hits / 2
    assert 0 < shuffled_rows(found) < 10 * (lookups + hits)  # lookups * hits before


def test_entries_of_payloads_are_never_broadcast(spark, tmp_path):
    from marlpath.sources import payloads

    path = str(tmp_path / "payloads")
    spark.range(50).select("id", F.lit('[{"slug": 1, "description": 2}, "a", "b"]').alias("payload"), F.lit("a").alias("slug")).write.parquet(path)
    for found, n in ((payloads.values(spark.read.parquet(path)), 100), (payloads.product_descriptions(spark.read.parquet(path)), 50)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and found.count() == n
    assert "BroadcastHashJoin" not in payloads.values(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()


def test_products_are_never_broadcast_and_pages_dealt_once(spark):
    from marlpath.plans import offer_queries

    found = offer_queries.told_details(spark, "/root/testdata/sf0.01")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    # the parts twice, for both readings, and the products: no page is shuffled, before it is read or after
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 3


@pytest.mark.parametrize("tasks", [None, 3])
def test_pages_of_one_id_share_a_product(spark, tasks):
    from marlpath.sources import product_pages

    script = lambda name, url: f'<script type="application/ld+json">{{"@type": "Product", "name": "{name}", "url": "{url}"}}</script>'
    rows = [(1, "https://a.mx/p", script("Other", "/q")), (1, "https://a.mx/p", script("Own", "/p")), (1, "https://a.mx/p", "<h1>T</h1>"), (2, None, script("Two", "")), (3, "u", None), (None, "u", script("None", "")), (2**60 + 1, "u", script("Far", ""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = product_pages.product_pages(pages if tasks is None else pages.repartition(tasks, "page_id"), tasks)
    got = sorted(str(tuple(r)) for r in found.select("page_id", "url", "h1", "product.name").collect())
    want = [(1, "https://a.mx/p", "", "Own")] * 2 + [(1, "https://a.mx/p", "T", "Own"), (2, "", "", "Two"), (3, "u", "", None), (None, "u", "", None), (2**60 + 1, "u", "", "Far")]
    assert got == sorted(map(str, want))


def test_related_links_and_payloads(spark):
    from marlpath.operators import curation
    from marlpath.sources import payloads

    got = records.related(records.things(spark.createDataFrame([(XML,)], "xml string"))).collect()
    assert [tuple(r) for r in got] == [(7, 0, "extension", 9, True)]
    made = [(1, '[{"a": 1, "b": 2}, [3], "x", 7]'), (2, "[[0]]"), (3, "[]"), (4, "{"), (5, None), (6, '[{"a": "text", "b": true, "c": -1}]'), (7, '["only"]')]
    found = {(r["id"], ".".join(r["path"])): r["value"] for r in payloads.values(spark.createDataFrame(made, "id long, payload string")).collect()}
    assert found == {(1, "a.[0]"): "7", (1, "b"): "x", (2, "[0]"): None, (6, "a"): None, (6, "b"): None, (6, "c"): None, (7, ""): "only"}
    names = lambda *v: spark.createDataFrame(list(enumerate(v)), "pos int, name string")
    core = names("a", "A", "tienda juegos de mesa leon mexico").withColumnRenamed("name", "text")
    texts = lambda scope: [r["text"] for r in curation.search_texts(core, names("Leon"), names("Jalisco"), scope).orderBy("pos").collect()]
    assert texts("core") == ["a", "tienda juegos de mesa leon mexico"] and texts("expanded") == [*texts("core"), "juegos de mesa tienda online Leon"] and len(texts("full")) == 5
    with pytest.raises(ValueError):
        texts("all")


def test_listing_fallbacks_and_links(spark):
    from marlpath.operators import curation

    items = spark.createDataFrame([(1,), (2,)], "id long")
    links = spark.createDataFrame([(5, 1, "u", "old", "en", "x", "HIDDEN"), (6, 1, "u", "twin", "en", "x", "HIDDEN")], "id long, item_id long, url string, title string, language string, source string, status string")
    new = spark.createDataFrame([(1, "u", "first", 1), (1, "u", "new", 2), (2, "v", "other", 3), (9, "w", "nobody's", 4)], "item_id long, url string, title string, pos int")
    got = sorted((r["id"], r["item_id"], r["title"], r["status"]) for r in curation.links_after(links, items, new).collect())
    assert got == [(5, 1, "new", "ACTIVE"), (6, 1, "twin", "HIDDEN"), (7, 2, "other", "ACTIVE")]


def test_links_are_handed_on_in_parts_and_batches_read_one_by_one():
    import pyarrow as pa
    from marlpath.sources import pages

    read = []

    def batches():
        for k in range(3):
            read.append(k)
            html = [f"<p>{'w' * 3000}</p><a href='/a{i}'>t{i}</a><p>{'v' * 2000}</p><a href='/b{i}'>u</a>" for i in range(400)]
            yield pa.record_batch([list(range(k * 400, k * 400 + 400)), ["https://a.mx/"] * 400, html], names=["page_id", "url", "html"])

    made = pages.near_links(batches())
    first = next(made)
    assert read == [0] and 0 < first.num_rows < 400
    parts = [first, *made]
    assert max(p.nbytes for p in parts) < 1_200_000 and sum(p.num_rows for p in parts) == 2400
    assert parts[-1].slice(parts[-1].num_rows - 1).to_pylist() == [{"page_id": 1199, "pos": 3, "url": "https://a.mx/b399", "title": "u", "context": "v" * 2000}]
