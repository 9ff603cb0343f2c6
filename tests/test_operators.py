"""What SQL does not reach: transcripts, partitions, warping, agents, sources, streams."""

import collections
import datetime as dt
import hashlib
import http.server
import itertools
import json
import threading

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import math_answers as ma
from quern.functions import text as tx
from quern.operators import agent, ml, ranks, retrieval, sampling
from quern.operators import timeseries as ts
from quern.sources import indexes, service, tables
from quern.streaming import hours

INFO = '<information>\nDoc 1(Title: "T1") alpha\nDoc 2(Title: "T2") beta\n</information>\n'
CASES = [
    ("", []),
    ("no blocks at all", []),
    (INFO, [("T1", "alpha"), ("T2", "beta")]),
    (INFO + "<important_info>[2]</important_info>", [("T2", "beta")]),
    (INFO + "<important_info>Doc1</important_info>", [("T1", "alpha")]),
    (INFO + "<important_info>Doc 1, doc 2</important_info>", [("T1", "alpha"), ("T2", "beta")]),
    (INFO + "<important_info>7</important_info>", []),
    (INFO + INFO.replace("alpha", "gamma") + "<important_info>1</important_info>", [("T1", "gamma"), ("T1", "alpha"), ("T2", "beta")]),
    (INFO + "<important_info>1</important_info>" + INFO + "<important_info>2</important_info>", [("T1", "alpha"), ("T2", "beta")]),
    (INFO + "<important_info>1</important_info><important_info>2</important_info>", [("T1", "alpha")]),
    (INFO + INFO, [("T1", "alpha"), ("T2", "beta")]),
    ('<information>Doc 1(Title: "T1") open', []),
    ('<information>Doc 1(Title: "T1") <think>x</think> <query>y</query></information>', [("T1", "<think>x</think> <query>y</query>")]),
]


def test_documents_of_transcripts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i long, s string")
    got = {r["i"]: [(d["title"], d["text"]) for d in r["d"]] for r in df.select("i", retrieval.documents_of(F.col("s")).alias("d")).collect()}
    assert got == {i: c[1] for i, c in enumerate(CASES)}


def test_outcomes(spark):
    said = [("will die", 1, 1), ("He is unlikely to die.", 0, 1), ("unlikely to survive", 1, 1), ("low mortality risk", 0, 0), ("?", -1, -1)]
    df = spark.createDataFrame(said, "s string, fixed int, legacy int")
    assert df.filter((tx.outcome(F.col("s")) != F.col("fixed")) | (tx.outcome(F.col("s"), legacy=True) != F.col("legacy"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=0, max_size=40), st.integers(1, 6))
def test_karmarkar_karp_is_a_partition(lengths, k):
    parts = sampling.karmarkar_karp(lengths, k)
    assert len(parts) == k and sorted(itertools.chain(*parts)) == list(range(len(lengths)))
    even = lengths[: len(lengths) // k * k]
    assert {len(p) for p in sampling.karmarkar_karp(even, k, equal=True)} <= {len(even) // k}


def test_greedy_partition(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([9, 7, 6, 5, 5, 1])], "i long, n long")
    assert sorted(r["total"] for r in sampling.greedy_partition(df, "n", 3).collect()) == [10, 11, 12]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=120), st.integers(1, 6))
def test_longest_first_by_counts_is_item_by_item(lengths, k):
    loads = [0] * k
    for n in sorted(lengths, reverse=True):
        loads[loads.index(min(loads))] += n
    assert sampling.longest_first(list(collections.Counter(lengths).items()), k) == loads


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 6))
def test_partition_is_largest_differencing(lengths, k):
    """The same with every empty part kept."""
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    heap = [(-lengths[i] if k > 1 else 0, n, [[lengths[i], [i]], *([0, []] for _ in range(k - 1))]) for n, i in enumerate(order)]
    n = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = (heap.pop(heap.index(min(heap, key=lambda x: x[:2]))) for _ in range(2))
        both = sorted(([x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        heap.append((both[-1][0] - both[0][0], n, both))
        n += 1
    assert sorted(sampling.karmarkar_karp(lengths, k)) == sorted(sorted(p[1]) for p in heap[0][2])


def test_warping_is_the_plain_recurrence():
    rng = np.random.default_rng(0)
    a, b = rng.random((4, 7)), rng.random((4, 5))
    for x, y, d in zip(a, b, retrieval.warped(a, b), strict=True):
        t = np.full((8, 6), np.inf)
        t[0, 0] = 0
        for i in range(7):
            for j in range(5):
                t[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(t[i, j], t[i, j + 1], t[i + 1, j])
        assert d == pytest.approx(np.sqrt(t[7, 5]))


def test_dense_topk_in_blocks(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "doc_id long, v array<double>")
    queries = corpus.filter("doc_id < 6").withColumnRenamed("doc_id", "query_id")
    whole = {tuple(r) for r in retrieval.dense_topk(corpus, queries, 3).collect()}
    assert {tuple(r) for r in retrieval.dense_topk(corpus, queries, 3, block=4).collect()} == whole
    want = {(q, r + 1, d, s) for q, v in rows[:6] for r, (s, d) in enumerate(sorted(((sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows), key=lambda x: (-x[0], x[1]))[:3])}
    assert whole == want


def test_sums_before_rows(spark):
    rows = [(i, None if i % 7 == 0 else f"g{i % 3}", float(i * i % 101)) for i in range(500)] + [(1000, "g1", None)]
    df = spark.createDataFrame(rows, "i long, g string, x double")
    got = {r["i"]: (r["n"], r["s"]) for r in ranks.before(df, ["g"], ranks.number_order(df, "i"), n=F.lit(1), s=F.col("i")).collect()}
    assert got == {i: (sum(h == g and j < i for j, h, _ in rows), sum(j for j, h, _ in rows if h == g and j < i)) for i, g, _ in rows}
    hashed = sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}|42".encode()).hexdigest(), r[0]))
    assert [r["i"] for r in ranks.with_place(df, [], ranks.md5_order("i"), "p").orderBy("p").collect()] == [r[0] for r in hashed]
    down = ranks.with_place(df.filter("i < 30"), [], ranks.number_order(df, "i", ascending=False), "p").orderBy("p").collect()
    assert [r["i"] for r in down] == list(range(29, -1, -1))
    assert ranks.with_place(df.limit(0), ["g"], ranks.number_order(df.limit(0), "i")).count() == 0


def test_places_need_no_window_over_a_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source")
    plan = sampling.model_batches(docs, "doc_id", 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number" not in plan
    assert {r["n"] for r in sampling.model_batches(docs, "doc_id", 8).groupBy("batch").agg(F.count("*").alias("n")).collect()} == {8}


def test_micro_batches_hold_every_row_once(spark):
    df = spark.createDataFrame([(b, i, 10 + i * 37 % 90) for b in "ab" for i in range(50)], "b string, i long, n long")
    out = sampling.micro_batches(df, "b", "i", "n", 500).join(df, ["b", "i"]).toPandas()
    for _, g in out.groupby("b"):
        assert len(g) == 50 and g.parts.nunique() == 1 and set(g.part) == set(range(g.parts.iloc[0])) and g.parts.iloc[0] == -(-g.n.sum() // 500)
        assert g.groupby("part").n.sum().max() - g.groupby("part").n.sum().min() < 30


def test_stored_indexes(spark, data, tmp_path):
    corpus = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    queries = spark.read.parquet(f"{data}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text").limit(5)
    indexes.write_postings(corpus, str(tmp_path / "p"), 4)
    want = {tuple(r) for r in retrieval.bm25_topk(corpus, queries, 5).collect()}
    assert {tuple(r) for r in indexes.search_postings(spark, str(tmp_path / "p"), queries, 5).collect()} == want
    assert {tuple(r) for r in indexes.search_postings(spark, str(tmp_path / "p"), queries, 5, most_terms=1).collect()} == want
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    indexes.write_vectors(vectors, str(tmp_path / "v"), rows=20)
    hits = indexes.search_vectors(spark, str(tmp_path / "v"), vectors.limit(3).withColumnRenamed("doc_id", "query_id"), 1).collect()
    assert all(r["query_id"] == r["doc_id"] for r in hits) and len(hits) == 3
    indexes.write_batch(corpus.limit(3), {"step": 7}, str(tmp_path / "b"))
    rows, meta = indexes.read_batch(spark, str(tmp_path / "b"))
    assert rows.count() == 3 and meta == {"step": 7}


def test_retrieval_service(spark):
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(len(body["queries"]))
            if len(asked) == 1:  # the first request fails once
                self.send_error(503)
                return
            answer = {"result": [[{"document": {"id": f"{q}{k}", "title": "t", "text": q, "contents": q}, "score": 1.0 - k} for k in range(body["topk"])] for q in body["queries"]]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "query_id long, query string").coalesce(1)
    out = service.retrieved(queries, f"http://127.0.0.1:{server.server_port}/retrieve", 2, batch=2, pause=0.01).collect()
    server.shutdown()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in out) == [(i, k + 1, f"q{i}{k}", 1.0 - k) for i in range(5) for k in range(2)]
    assert max(asked) == 2


def test_agents_of_other_kinds(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "id long, question string")
    keep = lambda df: df.persist()
    about = lambda q: q.withColumn("information", F.concat(F.lit("about "), "query"))
    tags = lambda df: df.withColumn("response", F.when(F.contains("history", F.lit("<information>")) | (F.col("id") == 2), "<answer>x</answer>").otherwise("<think>t</think><search> s </search>"))
    out = agent.search_loop(questions, tags, about, 3, keep, agent.search_tag_action, agent.search_tag_query)
    assert {r["id"]: (r["searches"], "about s" in r["history"], r["done"]) for r in out.collect()} == {1: (1, True, True), 2: (0, False, True)}
    thinks = lambda df: df.withColumn("response", F.when((F.col("id") == 2) | (F.size("chain") == 1), " so <search_complete>YES</search_complete>").otherwise("first <search_complete>no</search_complete>"))
    out = {r["id"]: r for r in agent.interleaved(questions, thinks, about, 4, keep).collect()}
    assert out[1]["context"] == "about a\nabout first" and len(out[1]["chain"]) == 2 and out[2]["context"] == "about b" and out[2]["done"]
    never = agent.interleaved(questions, lambda df: df.withColumn("response", F.lit("on")), about, 4, keep).collect()
    assert all(len(r["chain"]) == 4 and not r["done"] for r in never)
    asks = lambda df: df.withColumn("response", F.when((F.col("id") == 2) | (F.col("searches") == 1), "done").otherwise("<|begin_search_query|> s <|end_search_query|>"))
    out = {r["id"]: r for r in agent.analysed(questions, asks, about, lambda df: df.withColumn("analysis", F.upper("information")), 4, keep).collect()}
    assert "<|begin_search_result|>\nABOUT S\n<|end_search_result|>" in out[1]["history"] and out[1]["searches"] == 1 and out[2]["searches"] == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x\"y", "c1"), (2, None, "c1"), (3, "z", "c2")], "a long, b string, c string")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), "a long, b string, c string").collect())) == sorted(map(tuple, df.collect()))
    tables.write_texts(df.filter("b is not null"), str(tmp_path / "t"), "c", "b")
    assert {r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()} == {'x"y', "z"}
    tables.append_metrics(df.select(F.struct("a").alias("loss")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).columns == ["loss/a"]
    assert [r["id"] for r in tables.chunk_ids(df, "c", "a").orderBy("a").collect()] == ["c1_0", "c1_1", "c2_0"]
    assert tables.first_split({"test": None, "dev": df}) is df
    df.select("a").write.parquet(str(tmp_path / "p1"))
    df.write.parquet(str(tmp_path / "p2"))
    assert tables.read_parquets(spark, str(tmp_path / "p1"), str(tmp_path / "p2")).count() == 6
    tables.write_json_array(df, str(tmp_path / "j"))
    assert tables.read_json_array(spark, str(tmp_path / "j"), "a long, b string, c string").count() == 3


def test_key_scan(spark, tmp_path):
    (tmp_path / "big.csv").write_text("subject_id,itemid,value\n" + "".join(f"{i % 10},{i},v\n" for i in range(100)))
    keys = spark.createDataFrame([(3,), (4,)], "subject_id long")
    got = tables.scan_keys(spark, str(tmp_path / "big.csv"), "subject_id long, itemid long, value string", keys, "subject_id", ["itemid"])
    assert got.columns == ["subject_id", "itemid"] and got.count() == 20


def test_risk_models(spark):
    rows = [(i, k, float(i % 2) + i / 100 if j else None, 1.0) for i in range(60) for j, k in enumerate(["a", "b"]) if not (k == "b" and i % 5 == 0) or j]
    stats = spark.createDataFrame(rows, "e long, k string, mean double, std double")
    stats = stats.withColumns({c: F.col("mean") for c in ("min", "max", "median")}).withColumn("availability", F.lit(1.0))
    people = spark.createDataFrame([(i, 30.0 + i) for i in range(50)], "e long, age double")
    table = ml.feature_table(stats, "e", "k", ["a", "b"], people, people.select("e", F.lit("c").alias("code"))).withColumn("label", (F.col("e") % 2).cast("double"))
    names = [f"b_{s}" for s in ml.STATS] + ["age", "n_codes"]
    for kind in ("forest", "logistic"):
        model = ml.fit(table, names, "label", kind)
        out = model.transform(table)
        assert out.filter("prediction = label").count() >= 58
    scaled = [r["features"].toArray() for r in out.collect()]
    assert np.allclose(np.mean(scaled, axis=0), 0, atol=1e-9) and np.allclose(np.std(scaled, axis=0)[0], 1)
    forest = ml.fit(table, names, "label")
    assert abs(sum(x for _, x in ml.importances(forest, names)) - 1) < 1e-9


def test_conversations_of_a_stream(spark, data, tmp_path):
    path = str(tmp_path / "in")
    whole = spark.read.parquet(f"{data}/conversations.parquet")
    whole.repartition(3).write.parquet(path)
    got = {}
    stream = hours.conversation_state(hours.read_stream(spark, path, whole.schema, files=1))
    q = hours.into_table(stream, "", str(tmp_path / "c"), "update", lambda df, _: got.update({r["conversation"]: (r["turns"], r["last_turn"], r["last_role"]) for r in df.collect()}))
    q.awaitTermination(180)
    want = whole.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("t"), F.max_by("role", "turn").alias("r")).collect()
    assert got == {r["conv_id"]: (r["n"], r["t"], r["r"]) for r in want}


def test_hours_before_the_origin_round_down(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 12, 31, 23, 30),), (dt.datetime(2024, 1, 1, 0, 30),)], "ts timestamp_ntz")
    assert [r["hour"] for r in ts.with_hour(df, "2024-01-01 00:00:00").orderBy("ts").collect()] == [-1, 0]


def test_locf_of_gaps(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None)], "k int, hour int, value double")
    assert [r["value"] for r in ts.locf(df, ["k"]).orderBy("hour").collect()] == [0.0, 2.0, 2.0]


def test_math_answers():
    assert ma.canonical(ma.boxed(r"\boxed{a} then \boxed{\dfrac{1}{2}}")) == ma.canonical("1/2")
    assert ma.boxed("none") is None and ma.boxed(r"\boxed{open") is None
    assert ma.boxed(r"$\boxed 5$ and $\boxed x+1$ then") == "x+1" and ma.boxed(r"\fbox{7} b") == "7" and ma.canonical(r"\sqrt3") == r"\sqrt{3}"
    assert ma.evaluate("2*(3-1)/4") == 1 and ma.evaluate("__import__('os')") is None and ma.evaluate("1/0") is None
    assert ma.countdown_ok("(1+2)*4", [1, 2, 4], 12) and not ma.countdown_ok("1+2", [1, 2, 4], 3)


def test_search_loop(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "id long, question string")

    def generate(df):  # the first asks until it has read something, the second at once says it is done
        asks = (F.col("id") == 1) & ~F.contains("history", F.lit("<information>"))
        return df.withColumn("response", F.when(asks, "<query>q</query>").otherwise("<search_complete>yes</search_complete>"))

    out = agent.search_loop(questions, generate, lambda q: q.withColumn("information", F.concat(F.lit("about "), "query")), 2, lambda df: df.persist())
    got = {r["id"]: (r["searches"], r["done"], "about q" in r["history"]) for r in out.collect()}
    assert got == {1: (1, True, True), 2: (0, True, False)}


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "title": "t"}\nnot json\n')
    assert [r["id"] for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, title string").collect()] == ["1"]
    (tmp_path / "b.json").write_text('[{"id": "1"}, {"id": "2"}]')
    assert tables.read_json_array(spark, str(tmp_path / "b.json"), "id string").count() == 2
    for s in (1, 2):
        (tmp_path / f"e/{s}").mkdir(parents=True)
        (tmp_path / f"e/{s}/episode{s}_timeseries.csv").write_text("Hours,pH\n0.5,7.1\n-1,x\n")
    df = tables.read_entities(spark, str(tmp_path / "e/*/episode*_timeseries.csv"), "Hours double, pH double")
    assert {(r["entity"], r["number"], r["pH"]) for r in df.collect()} == {("1", 1, 7.1), ("1", 1, None), ("2", 2, 7.1), ("2", 2, None)}
    out = str(tmp_path / "out")
    tables.write_per_source(df, out, "entity")
    assert spark.read.json(out).count() == 4
    nested = spark.createDataFrame([(1,)], "a int").select(F.struct(F.col("a").alias("b")).alias("x"), "a")
    assert nested.select(*tables.flat(nested)).columns == ["x/b", "a"]
    web = spark.createDataFrame([(1, '{"answer_box": {"answer": "42"}, "organic_results": [{"title": "t", "snippet": "s"}]}'), (2, "{}")], "q int, p string")
    assert [(r["q"], r["rank"], r["text"]) for r in tables.web_results(web, "p", 3).orderBy("rank").collect()] == [(1, 1, "42"), (1, 2, "s")]


def test_stream_of_hours_equals_the_batch(spark, data, tmp_path):
    path = str(tmp_path / "in")
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(path)
    batch = spark.read.parquet(path)
    stream = hours.read_stream(spark, path, batch.schema)
    got = []
    q = hours.into_table(hours.hourly_counts(stream), "", str(tmp_path / "c"), "complete", lambda df, _: got.append({(r["hour"], r["event_type"], r["n"]) for r in df.collect()}))
    q.awaitTermination(120)
    want = batch.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "event_type").count()
    assert got[-1] == {tuple(r) for r in want.collect()}
