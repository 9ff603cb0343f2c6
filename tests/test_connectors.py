"""Sources and sinks by name: round trips, retries, errors, and nothing half written."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quern.sources import connectors, indexes, retrievers, service, tables, vector_index


@pytest.fixture
def endpoint():
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body["queries"])
            if "bad" in body["queries"] or len(asked) == 1:  # the first request fails once, a bad one always
                self.send_error(503)
                return
            told = {"result": [[{"document": {"id": f"{q}{k}", "contents": q}, "score": 1.0 - k} for k in range(body["topk"])] for q in body["queries"]]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(told).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/retrieve"
    server.shutdown()


def test_retrieval_by_name(spark, tmp_path, endpoint):
    connectors.register(spark)
    path = str(tmp_path / "q")
    spark.createDataFrame([(i, "bad" if i == 7 else f"q{i}") for i in range(10)], "query_id long, query string").coalesce(1).write.option("parquet.block.size", 64).parquet(path)
    read = lambda **more: spark.read.format("quern_retrieval").options(url=endpoint, path=path, topk=2, batch=1, pause=0.01, tries=2, **more).load()
    rows = read(errors="column").collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in rows if r["error"] is None) == sorted((str(i), k + 1, f"q{i}{k}") for i in range(10) if i != 7 for k in range(2))
    assert [(r["query_id"], r["rank"]) for r in rows if r["error"]] == [("7", None)]
    with pytest.raises(Exception, match="503"):
        read().collect()
    with pytest.raises(Exception, match="give the url"):
        spark.read.format("quern_retrieval").option("path", path).load().collect()
    spark.createDataFrame([], "query_id long, query string").write.parquet(str(tmp_path / "none"))
    assert spark.read.format("quern_retrieval").options(url=endpoint, path=str(tmp_path / "none")).load().count() == 0


def test_retrievers_by_name(spark, tmp_path, endpoint):
    docs = spark.createDataFrame([(1, "T1\nred apples"), (2, "T2\nred cars and red boats"), (3, "T3\nblue")], "doc_id long, contents string")
    indexes.write_postings(docs.withColumnRenamed("contents", "text"), str(tmp_path / "p"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "doc_id long, v array<double>")
    vector_index.write_index(vectors, str(tmp_path / "v"))
    asked = spark.createDataFrame([(7, "apples"), (8, "nothing at all")], "id long, query string")
    found = lambda **o: {r["id"]: r["information"] for r in retrievers.retriever(**o)(asked).collect()}
    assert found(kind="bm25", path=str(tmp_path / "p"), corpus=docs, topk=2) == {7: "Doc 1(Title: T1) red apples\n"}
    encode = lambda q: F.when(F.contains(q, F.lit("apples")), F.array(F.lit(0.1), F.lit(2.0)))
    assert found(kind="dense", path=str(tmp_path / "v"), corpus=docs, topk=2, encode=encode) == {7: "Doc 1(Title: T3) blue\nDoc 2(Title: T2) red cars and red boats\n"}
    assert found(kind="service", url=endpoint, topk=1, batch=1, pause=0.01) == {7: "Doc 1(Title: apples) \n", 8: "Doc 1(Title: nothing at all) \n"}
    with pytest.raises(ValueError, match="bm25, dense, service"):
        retrievers.retriever("web")


def test_errors_of_a_service_as_a_column(spark, endpoint):
    queries = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "b")], "query_id int, query string").repartition(3)
    out = service.retrieved(queries, endpoint, 1, batch=1, errors="column", at_once=1, pause=0.01, tries=2)
    assert out.rdd.getNumPartitions() == 1
    assert sorted((r["query_id"], r["doc_id"], r["error"] is None) for r in out.collect()) == [(1, "a0", True), (2, None, False), (3, "b0", True)]
    with pytest.raises(ValueError):
        service.retrieved(queries, endpoint, 1, errors="ignore")


def lines(path):
    return sorted(line for f in path.glob("*.json") for line in f.read_text().splitlines())


def test_metrics_all_or_nothing(spark, tmp_path):
    connectors.register(spark)
    path = tmp_path / "m"
    df = spark.range(6).repartition(3).select(F.col("id").alias("step"), F.struct(F.lit(0.5).alias("loss"), F.struct(F.lit(1).alias("k")).alias("kl")).alias("train"))
    df.write.format("quern_metrics").mode("append").save(str(path))
    want = sorted(json.dumps({"step": i, "train/loss": 0.5, "train/kl/k": 1}) for i in range(6))
    assert lines(path) == want
    broken = df.withColumn("x", F.when(F.col("step") == 5, F.raise_error(F.lit("lost"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("quern_metrics").mode("append").save(str(path))
    assert lines(path) == want
    df.filter("step = 1").write.format("quern_metrics").mode("overwrite").save(str(path))
    assert len(lines(path)) == 1


def test_metrics_of_a_stream_once(spark, tmp_path):
    connectors.register(spark)
    schema = "step long, loss double"
    for n in range(3):
        spark.createDataFrame([(n, n / 2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.format("quern_metrics").option("path", str(tmp_path / "m")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert lines(tmp_path / "m") == sorted(json.dumps({"step": n, "loss": n / 2}) for n in range(3))
    # a batch told again leaves the table as it is
    again = connectors.MetricsStreamWriter(str(tmp_path / "m"))
    again.commit([again.stage(iter([{"step": 99}]))], 0)
    assert len(lines(tmp_path / "m")) == 3 and not list((tmp_path / "m" / "_staged").iterdir())


def test_json_arrays_of_large_partitions(spark, tmp_path):
    tables.write_json_array(spark.range(25).coalesce(1), str(tmp_path / "a"), rows=10)
    parts = sorted((json.loads(f.read_text()) for f in (tmp_path / "a").glob("*.txt")), key=lambda x: x[0]["id"])
    assert [len(p) for p in parts] == [10, 10, 5] and [r["id"] for p in parts for r in p] == list(range(25))
