from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.operators.latest import current
from tessera.plans.catalogue import STAR
from tessera.sources import files, rest, sinks
from tessera.streaming import ingest

G = "25a7d7d7-7f47-4ca5-b057-c6863860612c"


@pytest.fixture
def exports(tmp_path):
    for name, text in ((f"{G}/20250101/a.py", "x"), (f"{G}/20250202/a.py", "y"), (f"{G}/20250202/b.ipynb", "{}"), ("loose/c.md", "z"), ("loose/d.bin", "no")):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "in")


def test_binary_scan_and_latest_partition(spark, exports):
    docs = files.attributed(files.binary_documents(spark, [exports]), default_id="d")
    assert docs.count() == 4
    shot = files.snapshot(docs)
    assert "content" not in shot.columns and {r["workspace_id"] for r in shot.collect()} == {G, "d"}
    assert sorted(r["path"].rsplit("/", 2)[-2] for r in files.latest_partitions(docs).collect()) == ["20250202", "20250202", "loose"]
    assert [r["path"][-4:] for r in files.binary_documents(spark, [exports], most=1).collect()] == ["a.py"]
    assert files.spread(docs, 401).rdd.getNumPartitions() == 3
    with pytest.raises(FileNotFoundError):
        files.binary_documents(spark, [exports], "*.none")


def test_items(spark):
    got = files.items(spark, [{"id": "1", "name": "n"}, {"id": "2", "displayName": "", "type": "Report"}]).collect()
    assert [(r["displayName"], r["type"]) for r in got] == [("n", "Notebook"), ("2", "Report")]
    assert files.replayed(spark, "no_such_table", "x") is None


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.append(spark.createDataFrame([("r1", 1)], "run_label string, a int"), at)
    sinks.append(spark.createDataFrame([("r2", 2, "x")], "run_label string, a int, b string"), at)
    assert {(r["run_label"], r["a"], r["b"]) for r in sinks.read_runs(spark, at).collect()} == {("r1", 1, None), ("r2", 2, "x")}
    sinks.overwrite(spark.range(3), at + "o")
    sinks.overwrite(spark.range(2), at + "o")
    assert spark.read.parquet(at + "o").count() == 2
    sinks.report(spark.range(2), at + "r")
    assert spark.read.option("header", "true").csv(at + "r/csv").columns == ["id"] and spark.read.json(at + "r/json").count() == 2
    sinks.log(spark.range(1), at + "l")
    sinks.log(spark.range(1), at + "l")
    assert spark.read.json(at + "l").count() == 2


def test_texts(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", "é\n"), ("c.txt", None)], "p string, t string")
    assert sinks.write_texts(df, "p", "t", str(tmp_path)) == 2 and (tmp_path / "a/b.txt").read_bytes() == "é\n".encode() and sorted(x.name for x in tmp_path.iterdir()) == ["a", "c.txt"]
    with pytest.raises(Exception, match="leads out"):
        sinks.write_texts(spark.createDataFrame([("../x", "t")], "p string, t string"), "p", "t", str(tmp_path / "a"))


def test_star_schema_upserts(spark, tmp_path):
    root = str(tmp_path)
    sinks.ensure(spark, STAR, root)
    sinks.ensure(spark, STAR, root)
    new = spark.createDataFrame([("high", 1, "x"), ("low", 3, "y")], STAR["dim_severity"][1])
    sinks.write_facts(spark, root, STAR, "dim_severity", new)
    sinks.write_facts(spark, root, STAR, "dim_severity", spark.createDataFrame([("high", 9, "z")], STAR["dim_severity"][1]))
    sinks.write_facts(spark, root, STAR, "dim_severity", new.limit(0))
    assert rows(current(spark, f"{root}/dim_severity")) == [("high", 9, "z"), ("low", 3, "y")]
    # a reader of the version before isn't disturbed by the next upsert; older versions go
    held = current(spark, f"{root}/dim_severity")
    sinks.write_facts(spark, root, STAR, "dim_severity", spark.createDataFrame([("low", 0, "q")], STAR["dim_severity"][1]))
    assert rows(held) == [("high", 9, "z"), ("low", 3, "y")] and rows(current(spark, f"{root}/dim_severity")) == [("high", 9, "z"), ("low", 0, "q")]
    assert sum(p.name.startswith("_v-") for p in (tmp_path / "dim_severity").iterdir()) == 2 and current(spark, f"{root}/dim_item_type").count() == 0
    with pytest.raises(ValueError):
        sinks.write_facts(spark, root, STAR, "other", new)


def service(answers):
    asked = []

    def get(url, headers):
        asked.append(url)
        a = answers[url].pop(0) if isinstance(answers[url], list) else answers[url]
        return a if isinstance(a, tuple) else (200, {}, json.dumps(a))

    return get, asked


def test_paging_ways():
    get, _ = service({"http://s/a": {"value": [1], "continuationUri": "http://s/b"}, "http://s/b": {"value": [2], "nextLink": None}})
    assert list(rest.pages(get, "http://s/a", {})) == [[1], [2]]
    get, _ = service({"http://s/a": {"value": [1], "continuationToken": "t"}, "http://s/a?continuationToken=t": {"value": [2]}})
    assert list(rest.pages(get, "http://s/a", {}, "token")) == [[1], [2]]
    get, _ = service({"http://s/a?%24top=2&%24skip=0": [[1, 2]], "http://s/a?%24top=2&%24skip=2": [[3]]})
    assert list(rest.pages(get, "http://s/a", {}, "offset", 2)) == [[1, 2], [3]]
    get, _ = service({"http://s/a": {"value": [1], "nextLink": "http://s/a"}})
    assert list(rest.pages(get, "http://s/a", {})) == [[1]]


def test_retries_and_polling():
    waits = []
    get, _ = service({"u": [(429, {"Retry-After": "3"}, ""), (503, {"Retry-After": "soon"}, ""), (200, {}, "{}")]})
    assert rest.patient(get, "u", {}, waits.append)[0] == 200 and waits == [3.0, 2.0]
    get, asked = service({"u": (500, {}, "x")})
    assert rest.patient(get, "u", {}, waits.append)[0] == 500 and len(asked) == rest.TRIES
    with pytest.raises(OSError):
        list(rest.pages(get, "u", {}, sleep=waits.append))
    get, _ = service({"u": [(202, {}, ""), (200, {}, '{"status":"Running"}'), (200, {}, '{"status":"Succeeded"}')]})
    assert rest.poll(get, "u", {}, sleep=waits.append)[2] == '{"status":"Succeeded"}'

    def broken():
        raise OSError("no")

    assert rest.first_filled(broken, lambda: [], lambda: [1]) == [1] and rest.first_filled(lambda: []) == []
    with pytest.raises(OSError):
        rest.first_filled(broken)


def fake(url, headers):
    return 200, {}, json.dumps({"value": [{"id": url}, {"id": 2}]})


def test_rest_source(spark, tmp_path, monkeypatch):
    rest.register(spark)
    (tmp_path / "fake_service.py").write_text("import json\ndef fake(url, headers):\n    return 200, {}, json.dumps({'value': [{'id': url}, {'id': 2}]})\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "fake_service.py"))
    df = spark.read.format("rest_pages").option("urls", "http://s/a\nhttp://s/b").option("fetcher", "fake_service:fake").load()
    assert sorted((r["url"], json.loads(r["record"])["id"]) for r in df.collect() if "http" in r["record"]) == [("http://s/a", "http://s/a"), ("http://s/b", "http://s/b")]


def test_streams(spark, tmp_path, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    once = lambda: ingest.run_once(ingest.new_documents(spark, str(tmp_path / "in"), e.schema, 2), str(tmp_path / "cp"), ingest.append_batches(str(tmp_path / "out"))).awaitTermination()
    once()
    once()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
    from pyspark.sql import functions as F

    timed = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = ingest.windowed_counts(timed, "10 minutes", "1 day").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == e.count()


class Script:
    """A service that answers as told, address by address, and notes what it was asked."""

    def __init__(self, **answers):
        self.answers, self.asked = {k: list(v) for k, v in answers.items()}, []

    def __call__(self, method, url, headers):
        self.asked.append((method, url, headers.get("token")))
        answer = self.answers[url].pop(0) if len(self.answers[url]) > 1 else self.answers[url][0]
        if isinstance(answer, Exception):
            raise answer
        return answer


@pytest.mark.parametrize(
    "answers, want, asked",
    [
        ({"u": [(200, {}, "{}")]}, ("{}", 200, 1, 0, None), 1),
        ({"u": [(429, {"retry-after": "7"}, ""), (503, {}, ""), (200, {}, "{}")]}, ("{}", 200, 3, 0, None), 3),
        ({"u": [(401, {}, ""), (200, {}, "{}")]}, ("{}", 200, 2, 1, None), 2),
        ({"u": [(404, {}, "gone")]}, (None, 404, 1, 0, "gone"), 1),
        ({"u": [(500, {}, "broken")]}, (None, 500, 5, 0, "broken"), 5),
        ({"u": [(202, {"Location": "op"}, "")], "op": [(200, {}, '{"status":"Running"}'), (200, {}, '{"status":"Succeeded"}')], "op/result": [(200, {}, "[1]")]}, ("[1]", 200, 1, 0, None), 4),
        ({"u": [(202, {"x-ms-operation-id": "9"}, "")], "ops/9": [(200, {}, '{"status":"Failed"}')]}, (None, 200, 1, 0, 'operation failed: {"status":"Failed"}'), 2),
        ({"u": [(202, {}, "")]}, (None, 202, 1, 0, "accepted without a place to ask"), 1),
        ({"u": [OSError("lost")]}, (None, 0, 1, 0, "OSError: lost"), 1),
    ],
)
def test_definitions(answers, want, asked):
    from tessera.sources.definitions import Exchange, definition

    waits, ask = [], Script(**answers)
    assert definition(Exchange(ask, {"token": "old"}, lambda: {"token": "new"}, waits.append), "u", "ops") == want and len(ask.asked) == asked
    assert all(t == "new" for _, _, t in ask.asked[1:]) if want[3] else all(t == "old" for _, _, t in ask.asked)
    assert waits[:1] == [7.0] if asked == 3 else True


def test_definitions_end_when_an_operation_never_does(monkeypatch):
    from tessera.sources import definitions as d

    monkeypatch.setattr(d, "QUESTIONS", 3)
    ask = Script(u=[(202, {"location": "op"}, "")], op=[(200, {}, '{"status":"Running"}')])
    assert d.definition(d.Exchange(ask, {}, None, lambda _: None), "u")[4] == "not done after 3 questions"
    # without a way to renew the token, unauthorized is final
    assert d.definition(d.Exchange(Script(u=[(401, {}, "")]), {}), "u") == (None, 401, 1, 0, "answered 401")


def test_fetched_definitions_keep_columns_and_report_missing_addresses(spark):
    from tessera.sources.definitions import fetched_definitions, scanned_in_batches

    df = spark.createDataFrame([("a0", "x", 1), ("a5", "y", 2), (None, "z", 3)], "url string, item_id string, n int")
    got = {r["item_id"]: r for r in fetched_definitions(df, "url", "tessera.plans.pipelines:rehearsal", wait=False, tasks=2).collect()}
    assert got["x"]["http_status"] == 200 and got["y"]["fetch_error"] == "no such item" and got["z"]["fetch_error"] == "no address" and got["z"]["n"] == 3
    ids = spark.createDataFrame([(f"i{k}",) for k in range(250)] * 2 + [(None,)], "id string")
    batches = scanned_in_batches(ids, "id").collect()
    assert sorted(i for b in batches for i in b["ids"]) == sorted(f"i{k}" for k in range(250)) and max(len(b["ids"]) for b in batches) <= 100


def test_names_are_looked_up_where_none_is_recorded(spark):
    df = spark.createDataFrame([("A", None), ("a", "own"), ("b", ""), (None, None)], "id_ string, name_ string")
    names = spark.createDataFrame([("a", "z"), ("A", "y"), ("", "no"), ("b", None)], "id string, name string")
    from tessera.sources.files import with_names

    assert [r["name_"] for r in with_names(df, names, "id_", "name_").orderBy(F.asc_nulls_last("id_"), "name_").collect()] == ["y", "own", None, None]


def test_stored_answers(tmp_path):
    (tmp_path / "p.json").write_text('{"value": [1]}')
    assert rest.stored(str(tmp_path / "p.json"), {}) == (200, {}, '{"value": [1]}') == rest.stored(f"file://{tmp_path}/p.json", {}) and rest.stored(str(tmp_path / "q"), {})[0] == 404
