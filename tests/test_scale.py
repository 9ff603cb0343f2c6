"""Operators that prune or split: the same rows as plain versions, and what they leave out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import batch, cohort, ml, neighbours, ranks, retrieval, rl, scoring
from quern.sources import indexes, vector_index


def clustered(rows: int, centres: int, dim: int, seed: int = 0) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    v = c[r.integers(0, centres, rows)] + 0.15 * r.normal(size=(rows, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def vectors(spark):
    v = clustered(3000, 24, 16)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, v array<double>").cache()


def plain_topk(v, q, k):
    s = np.round(q @ v.T, 6)
    return [[int(d) for d in np.lexsort((np.arange(len(v)), -row))[:k]] for row in s]


def test_index_types():
    assert vector_index.lists_of("Flat", 100) == 1 and vector_index.lists_of("IVF32,Flat", 100) == 32 and vector_index.lists_of("HNSW32", 400) == 20
    with pytest.raises(ValueError):
        vector_index.lists_of("PQ8", 10)


@pytest.mark.parametrize("kind", ["Flat", "IVF24,Flat", "HNSW32"])
def test_vector_index_is_exact_and_near(spark, vectors, tmp_path, kind):
    v, df = vectors
    path = str(tmp_path / "index")
    vector_index.write_index(df.unionByName(spark.createDataFrame([(9999, None)], df.schema)), path, kind, sample=1000)
    index = vector_index.Index(spark, path, block=500)  # lists larger than a block are cut
    assert index.sizes.sum() == 3000
    asked = df.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    queries = asked.unionByName(spark.createDataFrame([(-1, None)], asked.schema))
    q = [r["query_id"] for r in asked.orderBy("query_id").collect()]
    want = plain_topk(v, v[q], 5)

    def found(rows):
        out = {}
        for r in rows.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append(r["doc_id"])
        return [out[x] for x in q]

    assert found(index.search(queries, 5, digits=6)) == want
    near = found(index.search(queries, 5, probes=2, digits=6))
    recall = sum(len(set(a) & set(b)) for a, b in zip(near, want, strict=True)) / (5 * len(want))
    assert recall >= 0.9
    if kind != "Flat":
        # what a search reads: the folders of its lists alone
        one = asked.filter("query_id = 0")
        lists = index.probed(one, 2).first()["lists"]
        files = lambda df: df.select("_metadata.file_path").distinct().count()
        assert files(index.rows(lists)) <= 0.3 * files(index.rows(index.lists.tolist()))
        _, rest = index.reached(asked, 5)
        went = rest.select(F.sum(F.size("lists"))).first()[0]
        assert went < 0.5 * len(q) * len(index.lists)


def test_an_index_of_few_or_no_rows(spark, vectors, tmp_path):
    v, df = vectors
    with pytest.raises(ValueError):
        vector_index.write_index(df.limit(0), str(tmp_path / "none"))
    vector_index.write_index(df.filter("doc_id < 3"), str(tmp_path / "few"), "IVF8,Flat", normalised=False)
    hits = vector_index.Index(spark, str(tmp_path / "few"), normalised=False).search(df.filter("doc_id < 2").withColumnRenamed("doc_id", "query_id"), 5, digits=6)
    assert sorted((r["query_id"], r["rank"]) for r in hits.collect()) == [(q, k) for q in range(2) for k in (1, 2, 3)]


def test_postings_read_few_blocks(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(["the"] * r.randint(1, 3) + [f"w{r.randint(0, 3000)}" for _ in range(20)] + (["needle"] * 3 if i % 500 == 7 else []))) for i in range(4000)] + [(-1, None), (-2, "")]
    corpus = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "the needle"), (2, "The the w17"), (3, "nowhere"), (4, None), (5, "the")], "query_id long, text string")
    indexes.write_postings(corpus, str(tmp_path / "p"), docs=40, parts=8)
    index = indexes.Postings(spark, str(tmp_path / "p"))
    want = sorted(map(tuple, retrieval.bm25_topk(corpus, queries, 5).collect()))
    assert sorted(map(tuple, index.search(queries, 5).collect())) == want
    assert sorted(map(tuple, indexes.search_postings(spark, str(tmp_path / "p"), queries, 5, most_terms=1).collect())) == want
    home, rest, _ = index.plan(queries.filter("query_id = 1"), 5, first=8)
    assert home.count() == 5 and rest.count() == 0  # of the 100 blocks with the stop word
    # more results than the first blocks hold: all blocks are read
    assert len(index.search(queries.filter("query_id = 5"), 500, first=2).collect()) == 500


def plain_similarity(rows, k):
    stats, spread = {}, {}
    for e, i, x in rows:
        if x is not None:
            stats.setdefault(e, {}).setdefault(i, []).append(x)
            spread.setdefault(i, []).append(x)
    out = []
    for a in stats:
        near = []
        for b in stats:
            both = stats[a].keys() & stats[b].keys() if a != b else ()
            one = []
            for i in both:
                r = max(spread[i]) - min(spread[i])
                away = abs(np.mean(stats[a][i]) - np.mean(stats[b][i])) + abs(np.std(stats[a][i]) - np.std(stats[b][i]))
                one.append(min(max(1 - away / (2 * r), 0.0), 1.0) if r else 1.0)
            if one:
                near.append((-round(float(np.mean(one)), 6), b))
        out += [(a, n + 1, b, -s) for n, (s, b) in enumerate(sorted(near)[:k])]
    return sorted(out)


def test_neighbours_by_statistics(spark):
    r = random.Random(2)
    rows = [(e, i, r.gauss(e % 9 * 10, 1 + e % 3)) for e in range(180) for i in "abc" if (e + ord(i)) % 7 for _ in range(3)]
    rows += [(1000 + e, i, 5.0) for e in range(60) for i in "ab"] + [(2000, "z", 1.0), (2001, "z", 1.0), (2002, "y", 0.0), (2003, "a", None)]  # many alike, an item with one value, nothing shared
    df = spark.createDataFrame(rows, "e long, i string, x double")
    want = plain_similarity(rows, 4)
    for block in (16, 1000):
        got, pairs = neighbours.stat_neighbours(df, "e", "i", "x", 4, block)
        got = sorted(map(tuple, got.collect()))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
        assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) > 0.98 * len(want)  # roundings of ties apart
        blocks = -(-243 // block)
        assert pairs.count() < 0.8 * blocks * blocks + 1
    assert neighbours.stat_neighbours(df.limit(0), "e", "i", "x", 4)[0].count() == 0


def test_pairs_grow_slower_than_the_square(spark):
    r = random.Random(3)

    def compared(n):
        rows = [(e, i, x + d) for e in range(n) for i in "ab" for x in [r.uniform(0, 100)] for d in (0, 1)]
        return neighbours.stat_neighbours(spark.createDataFrame(rows, "e long, i string, x double"), "e", "i", "x", 3, block=32)[1].count()

    few, many = compared(512), compared(2048)
    assert many < 9 * few  # all pairs of blocks would be 16 times as many
    assert many < 0.35 * 64 * 64


def plain_warp(x, y):
    t = np.full((len(x) + 1, len(y) + 1), np.inf)
    t[0, 0] = 0
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            t[i + 1, j + 1] = (a - b) ** 2 + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return float(np.sqrt(t[-1, -1]))


def test_bounds_of_warping():
    r = np.random.default_rng(7)
    for n, m in [(1, 1), (1, 5), (4, 1), (2, 2), (9, 6), (12, 12)]:
        x, y = r.random((30, n)), r.random((30, m))
        d = np.array([plain_warp(a, b) for a, b in zip(x, y, strict=True)])
        assert retrieval.warped(x, y) == pytest.approx(d)
        assert all(neighbours.value_bound(a, b) <= z + 1e-12 for a, b, z in zip(x, y, d, strict=True))
        limit = d * r.choice([0.5, 0.99, 1.0, 1.5], 30)
        cut = retrieval.warped(x, y, limit)
        assert cut[limit >= d] == pytest.approx(d[limit >= d]) and np.isinf(cut[limit < d]).all()


@pytest.mark.parametrize("block", [7, 500])
@pytest.mark.parametrize("bonus", [1.0, 1.2])
def test_warped_neighbours(spark, block, bonus):
    r = random.Random(5)
    shapes = [[abs(math.sin((k + s) / 3)) for k in range(12)] for s in range(6)]
    rows = [(e, i, [x + r.uniform(0, 0.1) for x in shapes[(e + ord(i)) % 6][: 12 if e % 4 else 7]], e % 2) for e in range(40) for i in "abc" if (e + ord(i)) % 5]
    rows += [(90, "a", [0.0, 0.0], 0), (91, "light", [1.0], 1), (92, "only", [0.3], 1), (93, "only", [0.3, 0.4], 0)]
    weights = {"a": 2.0, "light": 0.01}
    some = {}
    for e, i, v, label in rows:
        if any(v) and weights.get(i, 1.0) >= 0.05:
            some.setdefault(e, (label, {}))[1][i] = v
    want = []
    for a, (la, sa) in some.items():
        near = []
        for b, (lb, sb) in some.items():
            shared = sa.keys() & sb.keys() if a != b else ()
            if shared:
                d = sum(weights.get(i, 1.0) * plain_warp(sa[i], sb[i]) for i in shared) / sum(weights.get(i, 1.0) for i in shared)
                near.append((-(bonus if la == lb else 1.0) / (1 + d), b))
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(sorted(near)[:3])]
    df = spark.createDataFrame(rows, "entity long, item string, v array<double>, label int")
    got = sorted(map(tuple, neighbours.dtw_topk(df, 3, weights, bonus, block).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)])
    work = neighbours.dtw_work(df, 3, weights, bonus, block).first()
    whole = work["pairs"] - work["by_ends"] - work["by_values"] - work["abandoned"]
    assert work["pairs"] == sum(bool(x.keys() & y.keys()) for e, (_, x) in some.items() for f, (_, y) in some.items() if e < f)
    assert whole < 0.7 * work["pairs"]


@pytest.mark.parametrize("bonus", [1.0, 1.2])
def test_warped_neighbours_of_one_shape(spark, monkeypatch, bonus):
    r = random.Random(11)
    step = lambda n: [0.0] * n + [1.0] * (10 - n)
    told = {}
    for e in range(140):
        told[f"e{e:03}"] = {i: step(r.randint(1, 9)) if r.random() < 0.8 else [0.0, r.random(), *step(r.randint(1, 7))[:7], r.random()] for i in "abc" if r.random() < 0.5}
    told |= {f"copy{n}": told["e001"] for n in range(3)} | {"minus": {"a": [-0.0, 1.0]}, "one": {"a": [1.0]}, "alone": {"z": [1.0]}}
    told = {e: (n % 2, s) for n, (e, s) in enumerate(told.items()) if s}
    want = []
    for a, (la, sa) in told.items():
        near = []
        for b, (lb, sb) in told.items():
            shared = sa.keys() & sb.keys() if a != b else ()
            if shared:
                near.append((-(bonus if la == lb else 1.0) / (1 + sum(plain_warp(sa[i], sb[i]) for i in shared) / len(shared)), b))
        want += [(a, n + 1, b, -s) for n, (s, b) in enumerate(sorted(near)[:3])]
    rows = [(e, i, v, n) for e, (n, s) in told.items() for i, v in s.items()] + [("e000", "y", [None, 1.0], 0), ("one", "y", [float("nan"), 1.0], 0)]
    df = spark.createDataFrame(rows, "entity string, item string, v array<double>, label int")
    monkeypatch.setattr(neighbours, "_FIRST", 60)
    got = sorted(map(tuple, neighbours.dtw_topk(df, 3, label_bonus=bonus, block=32).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)])
    work = neighbours.dtw_work(df, 3, label_bonus=bonus, block=32).first().asDict()
    pairs = work.pop("pairs")
    assert pairs == sum(bool(x.keys() & y.keys()) for e, (_, x) in told.items() for f, (_, y) in told.items() if e < f)
    assert pairs - sum(work.values()) < 0.2 * pairs


@pytest.mark.parametrize("target", [1 << 20, 20])
def test_first_after_of_a_hot_entity(spark, target):
    r = random.Random(9)
    events = [(0 if r.random() < 0.4 else r.randint(1, 20), r.choice("abcd"), r.randint(0, 300), k, r.choice([None, r.random()])) for k in range(1500)] + [(None, "a", 5, -1, 0.1), (1, None, 5, -2, 0.2), (2, "a", None, -3, 0.3)]
    anchors = [(e, r.randint(-5, 310), f"n{k}") for k, e in enumerate([0] * 60 + list(range(22)) + [None])] + [(0, None, "x")]
    want = set()
    for e, at, n in anchors:
        first = {}
        for f, i, t, o, v in events:
            if e is not None and e == f and at is not None and t is not None and t >= at and (i not in first or (t, o) < first[i][0]):
                first[i] = ((t, o), v)
        want |= {(n, i, v) for i, (_, v) in first.items()}
    a = spark.createDataFrame(anchors, "user long, begin long, anchor string")
    b = spark.createDataFrame(events, "user long, item string, at long, id long, value double")
    out = cohort.first_after(a, b, "user", "begin", "at", "item", "anchor", "value", "id", target)
    assert {tuple(x) for x in out.collect()} == {w for w in want if w[1] is not None} | {w for w in want if w[1] is None}
    if target == 20:
        pieces = out._jdf.queryExecution().optimizedPlan().toString()
        assert "piece" in pieces


def test_buckets_follow_the_values(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") == 7, 1e6).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_007)) / 10_007).alias("x"))
    bucket, _ = ranks.number_order(df, "x")
    sizes = [r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) >= 1000 and max(sizes) < 2000
    # a third of all rows have one value: the second column splits them, and places still follow the order
    tied = df.select("id", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("x")).alias("x"))
    for up in (True, False):
        bucket, order = ranks.number_order(tied, "x", up, tie="id")
        assert max(r["count"] for r in tied.groupBy(bucket.alias("b")).count().collect()) < 2000
        small = tied.filter("id < 3000")
        placed = ranks.with_place(small, [], (bucket, order), "p").orderBy("p").select("p", "x").collect()
        assert [r["p"] for r in placed] == list(range(3000))
        xs = [r["x"] for r in placed]
        assert xs == sorted(xs, reverse=not up)


def test_merged_columns_are_checked_whatever_is_read(spark):
    a = spark.createDataFrame([(1, "x", 1)], "k int, c string, d int")
    b = spark.createDataFrame([(1, "y", 2)], "k int, c string, e int")
    for read in (lambda x: x.count(), lambda x: x.select("k", "e").collect(), lambda x: x.collect()):
        with pytest.raises(Exception, match="columns differ at 1"):
            read(batch.merged(a, b, "k"))
    assert [tuple(r) for r in batch.merged(a, b.withColumn("c", F.lit("x")), "k").collect()] == [(1, "x", 1, 2)]


def test_weights_of_labels(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (0,), (None,)], "y int")
    assert sorted(((r["y"], round(r["weight"], 6)) for r in ml.balanced(df, "y").collect()), key=str) == sorted([(1, 0.555556)] * 3 + [(0, 1.666667), (None, 1.666667)], key=str)
    plan = ml.balanced(df, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize(("gamma", "lam", "chunk"), [(0.99, 0.95, 4), (0.99, 0.95, 512), (1.0, 1.0, 3), (0.5, 0.0, 2), (0.9, 0.01, 64)])
def test_advantages_in_chunks(spark, gamma, lam, chunk):
    r = random.Random(4)
    rows = [(s, p, r.choice([None, r.gauss(0, 1)]), r.gauss(0, 1)) for s in ("a", "b", None) for p in sorted(r.sample(range(40), 23))]
    want = {}
    for s in ("a", "b", None):
        a = v = 0.0
        for _, p, x, y in sorted((z for z in rows if z[0] == s), key=lambda z: -z[1]):
            a = (x or 0.0) + gamma * v - y + gamma * lam * a
            v = y
            want[s, p] = (pytest.approx(a), pytest.approx(a + y))
    df = spark.createDataFrame(rows, "s string, p long, r double, v double")
    got = {(x["s"], x["p"]): (x["advantage"], x["ret"]) for x in rl.gae(df, ["s"], "p", "r", "v", gamma, lam, chunk).collect()}
    assert got == want


def test_advantages_of_a_long_sequence(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("s"), F.col("id").alias("p"), F.lit(1.0).alias("r"), F.lit(0.0).alias("v"))
    out = rl.gae(df, ["s"], "p", "r", "v", 0.99, 0.95)
    at = {r["p"]: r["advantage"] for r in out.filter("p IN (0, 511, 512, 500000, 999999)").collect()}
    c = 0.99 * 0.95
    assert at == {p: pytest.approx((1 - c ** (1_000_000 - p)) / (1 - c)) for p in at} and len(at) == 5
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_percentiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    r = random.Random(6)
    rows = [("a", float(r.randint(0, 50))) for _ in range(999)] + [("b", r.random()) for _ in range(10)] + [(None, 1.0), ("c", None)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {x["g"]: tuple(x)[1:] for x in scoring.percentiles(df, ["g"], "x", {"p50": 0.5, "p99": 0.99, "p0": 0.0, "p100": 1.0}).collect()}
    for g in ("a", "b", None):
        xs = [x for h, x in rows if h == g and x is not None]
        assert out[g] == pytest.approx(tuple(np.percentile(xs, [50, 99, 0, 100])))
    assert out["c"] == (None,) * 4
    hits = spark.createDataFrame([(r.randint(0, 1), r.randint(0, 9) / 10) for _ in range(300)], "t int, s double")
    pos, neg = ([x["s"] for x in hits.filter(F.col("t") == t).collect()] for t in (1, 0))
    assert scoring.auroc(hits, "t", "s").first()[0] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    plan = scoring.length_stats(df, "g", F.col("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_groups_of_many_items(spark):
    r = random.Random(8)
    items, pairs, want = [], [], {}
    for g in range(30):
        n = r.randint(1, 12)
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.25}
        cluster, k = [-1] * n, 0
        for i in range(n):
            if cluster[i] == -1:
                for j in range(i + 1, n):
                    if (i, j) in edges:
                        cluster[j] = k
                cluster[i] = k
                k += 1
        items += [(g, i) for i in range(n)]
        pairs += [(g, a, b) for a, b in edges]
        want |= {(g, i): c for i, c in enumerate(cluster)}
    i, p = spark.createDataFrame(items, "g int, item long"), spark.createDataFrame(pairs + pairs[:5], "g int, a long, b long")
    assert {(x["g"], x["item"]): x["cluster"] for x in batch.greedy_groups(i, p, "g", "item").collect()} == want
    assert {x["cluster"] for x in batch.greedy_groups(i, p.limit(0), "g", "item").filter("g = 0").collect()} == set(range(sum(x == 0 for x, _ in items)))
    # one group of 100,000 items, each like those of its ten
    many = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").alias("item"))
    tens = many.select("g", F.col("item").alias("a"), F.explode(F.sequence(F.col("item") + 1, (F.floor(F.col("item") / 10) + 1) * 10)).alias("b")).filter("floor(a / 10) = floor(b / 10)")
    out = batch.greedy_groups(many, tens, "g", "item")
    assert out.filter("cluster <> floor(item / 10)").count() == 0 and out.count() == 100_000


def test_truncation_can_refuse(spark):
    from quern.functions import prompts

    df = spark.createDataFrame([([1, 2, 3],)], "ids array<bigint>")
    assert df.select(prompts.truncated(F.col("ids"), 3)).first()[0] == [1, 2, 3]
    with pytest.raises(Exception, match="row of 3 ids, 2 at most"):
        df.select(prompts.truncated(F.col("ids"), 2)).collect()
    with pytest.raises(ValueError):
        prompts.truncated(F.col("ids"), 2, "center")
    with pytest.raises(ValueError):
        prompts.pooled(F.col("ids"), F.col("ids"), "pooler")


def test_conversations_that_end_are_forgotten(spark, tmp_path):
    from quern.streaming import hours

    rows = [[("a", 0, "user", 0), ("a", 0, "user", 0), ("b", 0, "user", 30)], [("a", 1, "assistant", 60), ("b", 1, "assistant", 4000)], [("c", 0, "user", 20_000)], [("c", 1, "user", 40_000), ("a", 5, "user", 41_000)], [("d", 0, "user", 90_000)]]
    schema = "conv_id string, turn long, role string, ts timestamp"
    out = []

    def run():
        stream = hours.conversation_state(hours.read_stream(spark, str(tmp_path / "in"), schema, files=1), ts="ts", idle="1 hour")
        q = hours.into_table(stream, "", str(tmp_path / "c"), "update", lambda df, _: out.extend(map(tuple, df.collect())))
        q.awaitTermination(180)

    for n, part in enumerate(rows):  # each start goes on from the state of the one before
        df = spark.createDataFrame([(c, t, w, s) for c, t, w, s in part], "conv_id string, turn long, role string, s long").select("conv_id", "turn", "role", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    ended = [x[:4] for x in out if x[4]]
    assert ended.count(("a", 2, 1, "assistant")) == 1 and ended.count(("b", 2, 1, "assistant")) == 1 and ended.count(("c", 2, 1, "user")) == 1
    assert ("a", 1, 5, "user", False) in out  # opened anew
    assert out.index(("a", 2, 1, "assistant", True)) < out.index(("a", 1, 5, "user", False))
    assert len(ended) == len(set(ended))
