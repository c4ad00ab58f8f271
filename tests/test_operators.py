from __future__ import annotations

import base64
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.functions.quantiles import exclusive_quantiles
from tessera.functions.rule_catalogue import RULES
from tessera.operators import blocks as bl
from tessera.operators.chunking import BOUNDARY, chunk_documents, cut_lines, pack
from tessera.operators.datasources import artifacts, placeholders, using
from tessera.operators.downloads import HANDLERS, classified, handler, manifest, outstanding, parts, resolve_types, source_part, split_plan
from tessera.operators.latest import first_by_window, latest_row, latest_with_ties, upsert
from tessera.operators.scan import Settings, direction, rule_hits, scan_block, scan_documents
from tessera.plans.catalogue import finding_facts, split_valid
from tessera.plans.scans import rule_totals, snippet_rule_totals


def test_pack_limits_and_order():
    cells = ["a" * 10, "", "b" * 10, "c" * 100, "d"]
    out = pack(cells, 60)
    assert max(map(len, out)) <= 60 and out[0] == "a" * 10 + BOUNDARY + "b" * 10 and "".join(out[1:3]) == "c" * 100 and out[-1] == "d"
    assert pack(["a" * 100, "b" * 100, "d"], 130, least=5) == ["a" * 100, "b" * 100 + BOUNDARY + "d"] and pack([], 10) == [] and pack(["", ""], 10) == []
    assert list(cut_lines("ab\ncd\nef", 5)) == ["ab", "cd\nef"] and list(cut_lines("abcdef", 4)) == ["abcd", "ef"]
    with pytest.raises(ValueError):
        pack(["a"], 0)


EXPORT = "# Fabric notebook source\n\n# METADATA ********************\n\n# META {\n# META   \"dependencies\": {\"lakehouse\": {\"default_lakehouse\": \"lh1\", \"default_lakehouse_name\": \"L\"}}\n# META }\n\n# CELL ********************\n\nimport requests\n\n# MARKDOWN ********************\n\n# hello\n#\n# there\n"


def test_blocks_of_each_container():
    assert bl.blocks(EXPORT, "a.py") == [("import requests", 0, "code", ""), ("hello\n\nthere", 1, "markdown", "")]
    assert bl.blocks(EXPORT, "a.py", extras=False) == [("import requests", 0, "code", "")]
    assert bl.attached_lakehouse(EXPORT, "a.py") == ("lh1", "L", None)
    nb = {"cells": [{"cell_type": "code", "source": ["a\n", "b"], "outputs": [{"text": ["o"], "data": {"text/plain": "p"}}]}, {"cell_type": "markdown", "source": "m"}], "metadata": {"dependencies": {"lakehouse": {"known_lakehouses": [{"id": "k1"}]}}}}
    assert [b.text for b in bl.blocks(json.dumps(nb), "a.ipynb")] == ["a\nb", "o", "p", "m"]
    assert bl.attached_lakehouse(json.dumps(nb), "a.ipynb")[0] == "k1"
    env = {"definition": {"parts": [{"path": "notebook-content.py", "payload": base64.b64encode(b"x = 1").decode()}, {"path": "e", "payload": ""}]}}
    assert bl.blocks(json.dumps(env), "") == [("x = 1", 0, "code", "notebook-content.py")]
    assert bl.blocks('{"properties": {"cells": [{"cell_type": "code", "source": "z"}]}}', "") == [("z", 0, "code", "")]
    assert bl.blocks("{broken", "a.json")[0].source_kind == "raw" and bl.blocks("# h", "a.md")[0].source_kind == "markdown" and bl.blocks(b"\xff\xfe", "")[0].source_kind == "raw"


def scan(text, kind="code", **s):
    return list(scan_block(bl.Block(text, 0, kind, ""), Settings(**s)))


def test_scan_detectors():
    code = 'import requests, os.path\nfrom azure.storage.blob import X\neval("1")\nrequests.post("https://hooks.slack.com/services/x", data=1)\n'
    found = scan(code)
    assert {f[0] for f in found} == {"pattern", "import", "dynamic_exec", "url", "potential_write"}
    assert next(f for f in found if f[0] == "url")[7] == "write" and next(f for f in found if f[3].startswith("Slack"))[4] == 4
    assert {f[1] for f in found if f[0] == "import"} == {"http_exfiltration", "cloud_storage_write"}
    assert scan("see https://a.example/x", "markdown")[0][7] == "reference" and scan("http://localhost:1/") == [] and scan("  ") == []
    assert all(f[2] in ("high", "critical") for f in scan(code, least_severity="high"))


def test_scan_hides_tokens_unless_asked():
    token = "AKIA" + "ABCDEFGHIJKLMNOP"
    line = f"key = '{token}'"
    assert token not in next(f for f in scan(line) if f[1] == "api_key_leak")[5]
    assert token in next(f for f in scan(line, clear=True) if f[1] == "api_key_leak")[5]
    assert "abcd" not in next(f for f in scan("password = 'abcdabcd1234'") if f[1] == "credential_access")[5]


PREFIXES = {
    "AKIA": "A" * 16, "ASIA": "B" * 16, "AIza": "c" * 35, "ya29.": "d" * 24, "ghp_": "e" * 36, "github_pat_": "f" * 82, "glpat-": "g" * 20, "hf_": "h" * 30, "sk_live_": "i" * 24, "rk_test_": "j" * 24,
    "pk_live_": "k" * 24, "key-": "a" * 32, "xoxb-": "1" * 12, "SK": "b" * 32, "AC": "c" * 32, "sq0atp-": "l" * 22, "npm_": "m" * 36, "dop_v1_": "a" * 64, "shpat_": "d" * 32, "shpss_": "e" * 32,
}


@pytest.mark.parametrize("prefix", PREFIXES)
def test_issued_tokens(prefix):
    assert any(f[1] == "api_key_leak" for f in scan(f"x = '{prefix}{PREFIXES[prefix]}'"))


@pytest.mark.parametrize("benign", ["x = 'hello'", "sha = 'abc'", "AKIA = 1", "npm install"])
def test_benign(benign):
    assert not any(f[1] == "api_key_leak" for f in scan(benign))


def test_directions_of_both_generations():
    from tessera.operators.first_generation import closest

    t = "requests.get(1); requests.post('https://x"
    assert (closest(t, t.index("https")), direction(t, t.index("https"), 300)) == ("write", "read_write")
    assert closest("https://x", 0) == direction("https://x", 0, 300) == "unknown" and direction(t, t.index("https"), 24) == "write"


def test_scan_documents_rows(spark):
    df = spark.createDataFrame([(1, "a.py", "x = 1"), (2, "b.py", "eval('1')"), (3, None, None), (4, "c.md", "")], "id long, p string, c string")
    got = {}
    for r in scan_documents(df, "id", "p", "c").collect():
        got.setdefault(r["id"], []).append(r)
    assert sorted(got) == [1, 2, 3, 4] and got[1][0]["finding_type"] is None and got[1][0]["line_number"] == 0 and got[2][0]["finding_type"] == "dynamic_exec"
    assert scan_documents(df.limit(0), "id", "p", "c").count() == 0


def test_rule_totals_have_every_rule(spark, tmp_path):
    number = next(r.number for r in RULES if "(?<" in r.regex)
    texts = [(1, "fastcp(a, b)\nx = fastcp (c, d)"), (2, "mssparkutils.fs.fastcp(a, b)"), (3, None)]
    for name, key, text, query in (("notebook_sources", "source_id", "source_text", rule_totals), ("fabric_url_scanner", "row_id", "match_snippet", snippet_rule_totals)):
        spark.createDataFrame(texts, f"{key} long, {text} string").write.parquet(f"{tmp_path}/{name}.parquet")
        assert [(r["hits"], r["documents"]) for r in query(spark, str(tmp_path)).collect() if r["rule"] == number] == [(2, 1)]


def test_rule_hits_match_the_kernel(spark):
    texts = ["requests.post(1)\nrequests.put(2)", "AccountKey=" + "a" * 44, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r["id"], r["rule"]): r["hits"] for r in rule_hits(df, "id", "t").collect()}
    from tessera.functions.rule_catalogue import RULES

    number = {r.message: r.number for r in RULES}
    want = {}
    for i, t in enumerate(texts):
        for f in scan(t or "", clear=True):
            if f[0] == "pattern":
                want[i, number[f[3]]] = want.get((i, number[f[3]]), 0) + 1
    assert got == want and want


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "a.py", "x\n" * 20), (2, "a.md", "no code"), (3, "a.py", None)], "id long, p string, c string")
    got = chunk_documents(df, "id", "p", "c", 15).orderBy("chunk_index").collect()
    ones = [r for r in got if r["id"] == 1]
    assert {r["id"] for r in got} == {1, 2} and max(len(r["chunk_text"]) for r in got) <= 15 and ones[0]["chunk_count"] == len(ones) and ones[0]["content_length"] == 40


def test_latest_three_ways(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), (None, 5, "n")], "k string, t int, v string")
    assert rows(latest_with_ties(df, ["k"], "t")) == [("a", 2, "y"), ("a", 2, "z")]
    assert ("a", 2, "z") in rows(latest_row(df, ["k"], "t")) and latest_row(df, ["k"], "t").count() == 3
    assert first_by_window(df, ["k"], [F.desc_nulls_last("t"), F.desc("v")]).count() == 3


def test_upsert_repeated_source_keys(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), (None, 1, "n")], "k string, t int, v string")
    source = spark.createDataFrame([("b", 2, "y"), ("b", 3, "z"), ("c", 1, "w"), (None, 9, "lost")], "k string, t int, v string")
    want = sorted([("a", 1, "x"), ("b", 3, "z"), ("c", 1, "w"), (None, 1, "n")], key=str)
    assert rows(upsert(target, source.union(source), "k", "t")) == want
    assert rows(upsert(target, source.limit(0), "k")) == rows(target)


def test_parts_and_manifest(spark):
    def body(*ps):
        return json.dumps({"definition": {"parts": [{"path": p, "payload": base64.b64encode(c).decode() if c is not None else "", "payloadType": "InlineBase64"} for p, c in ps]}})

    data = [("1", body(("notebook-content.py", b"abc"), ("e.json", None))), ("2", body(("other.txt", b"x"))), ("3", None), ("4", "{}"), ("5", body(("a/b.ipynb", b"\xff")))]
    df = spark.createDataFrame([("ws", "W", "Notebook", i, "n " + i, "py", b) for i, b in data], "workspace_id string, workspace_name string, item_type string, item_id string, display_name string, export_format string, body string")
    assert [(r["item_id"], r["part_path"]) for r in parts(df, "body").orderBy("item_id").collect()] == [("1", "notebook-content.py"), ("2", "other.txt"), ("5", "a/b.ipynb")]
    m = {r["item_id"]: r for r in manifest(df, "body", F.lit("/o"), F.lit("r"), F.lit("2025-01-01").cast("timestamp")).collect()}
    assert (m["1"]["status"], m["1"]["error"], m["1"]["part_count"], m["1"]["parts_saved"]) == ("ok", None, 2, 1)
    assert m["2"]["error"] == "no source part" and m["3"]["error"] == "no body" and m["4"]["error"] == "empty definition" and m["3"]["status"] == m["4"]["status"] == "error" and m["1"]["primary_target"] == "/o/r/W__ws/Notebook/n_1__1.py"
    assert len(m["1"].asDict()) == 21
    listing = spark.createDataFrame([(m["1"]["primary_target"],)], "path string")
    assert outstanding(manifest(df, "body", F.lit("/o"), F.lit("r"), F.current_timestamp()), listing, "primary_target").count() == 4
    got = spark.createDataFrame([(["x/notebook-content.SQL", "notebook-content.a.py"],)], "p array<string>").select(source_part(F.col("p"))).first()[0]
    assert got == "x/notebook-content.SQL"


def test_handlers():
    assert len(HANDLERS) == 10

    @handler("TestType")
    def f(item, parts):
        return parts

    with pytest.raises(ValueError):
        handler("testtype")(f)
    del HANDLERS["testtype"]


def test_classification_and_plan(spark):
    items = spark.createDataFrame([("1", "Lakehouse ", "L", "ws-a"), ("2", None, None, None), ("", "x", "x", "x"), (None, "x", "x", "x")], "item_id string, item_type string, display_name string, workspace_id string")
    plan = {r["item_id"]: r for r in split_plan(classified(items, ["LAKEHOUSE"]), "ws-a", "ws-b", "src").collect()}
    assert plan["1"]["action"] == "leave" and plan["2"]["action"] == "move" and plan["2"]["name"] == "2" and len(plan) == 2
    assert rows(resolve_types(items, ["lakehouse", "x"], ["X"])) == [("Lakehouse ",)]


def test_deep_scan(spark):
    w = {"id": "w1", "name": "W", "datasets": [{"id": "d1", "name": "D", "datasourceUsages": [{"datasourceInstanceId": "AA"}, {"datasourceInstanceId": "b"}]}], "dataflows": [{"objectId": "f1", "name": "F", "datasourceUsages": []}]}
    scans = spark.createDataFrame([("w1", json.dumps(w)), ("w2", '{"id":"w2"}'), ("w3", None)], "workspace_id string, body string")
    found = using(artifacts(scans, "body"), spark.createDataFrame([("aa",)], "t string"), "t")
    assert rows(found) == [("w1", "W", "Dataset", "d1", "D", ["aa"])]
    assert sorted(r["artifact_name"] for r in placeholders(scans, found).collect()) == ["(none)", "(none)", "D"]


def test_facts_are_stable_and_validated(spark):
    cols = "workspace_id string, source_dated_partition string, notebook_id string, cell_index int, line_number int, finding_type string, category string, severity string, message string, code_snippet string, url string, scanned_at timestamp"
    f = spark.createDataFrame([("w", None, "n", 1, 2, "url", "c", "low", "m", "s", None, None)] * 2 + [("w", None, "n", 0, 0, None, None, None, None, None, None, None)], cols)
    a, b = finding_facts(f, "r").collect(), finding_facts(f, "r").collect()
    assert a == b and len(a) == 1
    good, bad = split_valid(spark.createDataFrame([("1", "low"), ("2", "odd"), (None, "low")], "finding_id string, severity string"), "finding_id", {"odd severity": "severity IN ('low')"})
    assert good.count() == 1 and {tuple(r["failed"]) for r in bad.collect()} == {("odd severity",), ("finding_id is missing",)}


def test_first_generation_scan(spark):
    from tessera.operators.first_generation import SECRETS, closest, masked, scan_text, scan_texts

    assert len(SECRETS) == 15 and masked("abc") == "***" and masked("a" * 12) == "aaaa****aaaa"
    t = "spark.read.json('https://a.example/x')\nrequests.post('https://b.example/y')\nrequests.post('https://b.example/y')\nPassword=abcd1234;\n"
    found = list(scan_text(t, "code"))
    assert [(f[0], f[1]) for f in found if f[0]] == [("https://a.example/x", "read"), ("https://b.example/y", "write")]
    assert {f[2] for f in found if f[1] == "unknown"} == {"SQL Password"} and sum(f[1] == "potential_write" for f in found) == 1
    assert closest("x https://a", 2) == "unknown" and all(f[1] != "potential_write" for f in scan_text(t, "markdown"))
    cells = [{"cell_type": "code", "source": t, "outputs": [{"text": "https://c.example/z"}]}, {"cell_type": "markdown", "source": "see https://a.example/x"}]
    df = spark.createDataFrame([(1, "a.ipynb", json.dumps({"cells": cells})), (2, "b.py", "x = 1"), (3, None, None)], "id int, path string, t string")
    got = scan_texts(df, "id", "path", "t").collect()
    assert {(r["source_kind"], r["direction"]) for r in got if r["id"] == 1 and r["url"]} == {("code", "read"), ("code", "write"), ("output", "reference"), ("markdown", "reference")}
    assert [tuple(r)[1:] for r in got if r["id"] > 1] == [(None,) * 7] * 2


def test_fan_out(spark):
    from tessera.operators.fanout import call_all, call_statistics, outcomes

    def f(a):
        if a == "3":
            raise ValueError("three")
        return int(a) * 2

    calls = spark.createDataFrame([("s" + str(i % 2), str(i)) for i in range(10)], "s string, a string")
    done = call_all(calls, "s", "a", f, 2, 4)
    good, bad = outcomes(done)
    assert sorted(int(r["result"]) for r in good.collect()) == [0, 2, 4, 8, 10, 12, 14, 16, 18] and [r["error"] for r in bad.collect()] == ["ValueError: three"]
    stats = {r["spoke"]: r for r in call_statistics(done).collect()}
    assert stats["(all)"]["succeeded"] == 9 and stats["s1"]["failed"] == 1 and stats["s0"]["p50"] <= stats["s0"]["longest"]


def test_scores_are_asked_once(spark, tmp_path):
    from tessera.plans.audit import documents_of_chunks, length_scorer, parse_answers, score, stamped

    cols = "workspace_id workspace_name source_lakehouse_id source_lakehouse_name source_dated_partition notebook_id display_name attached_lakehouse_id attached_lakehouse_name attached_lakehouse_workspace_id attached_lakehouse_workspace_name content_hash chunk_text".split()
    row = lambda i, t: (*["x"] * 12, t, 9, i, 2)
    c = spark.createDataFrame([row(0, "a" * 500), row(1, "see http://x")], ", ".join(f"{x} string" for x in cols) + ", content_length long, chunk_index int, chunk_count int")
    got = stamped(score(c, length_scorer, str(tmp_path / "s"), 2, 5), "v", "p", "r").collect()
    assert {(r["chunk_index"], r["external_resource_access_score"], r["exfiltration_risk_score"]) for r in got} == {(0, 100, 0), (1, 12, 1)} and got[0]["run_id"] == "r"
    with pytest.raises(ValueError):
        score(c, length_scorer, str(tmp_path / "t"), most=1)
    one = documents_of_chunks(score(c, length_scorer, str(tmp_path / "u"))).collect()
    assert len(one) == 1 and one[0]["exfiltration_risk_score"] == 1 and one[0]["chunks_parsed"] == 2
    bad = parse_answers(spark.createDataFrame([("no json", None), ('{"external_resource_access_score":500,"exfiltration_risk_score":-20}', None), (None, "down")], "ai_response string, ai_error string")).collect()
    assert bad[0]["ai_error"].startswith("parse_error") and (bad[1]["external_resource_access_score"], bad[1]["exfiltration_risk_score"]) == (100, 0) and bad[2]["sources"] == [] and bad[2]["ai_error"] == "down"


def test_pending_and_first_candidate(spark):
    from tessera.plans.endpoints import capped, matching, pending, with_first

    body = '{"properties":{"privateLinkServiceConnectionState":{"status":"Pending","description":"run r1"}}}'
    c = spark.createDataFrame([("t", body), ("t", body.replace("r1", "r2")), ("t", None), ("t", body.replace("Pending", "Approved"))], "target string, body string")
    assert pending(c, "body", "r1").count() == 1 and pending(c, "body", None).count() == 2
    cand = spark.createDataFrame([("t", 2), ("t", 1)], "target string, n int")
    assert {r["n"] for r in with_first(c, cand, "target", ["n"]).collect()} == {1}
    m = spark.createDataFrame([("a", "pe-1", None), ("b", None, "/x/")], "mpe_id string, mpe_name string, target_resource_id string")
    assert matching(m, name="^$").count() == 1 and matching(m, ids=["a"], target="").count() == 1 and matching(m).count() == 2
    with pytest.raises(ValueError):
        capped(m, 1)


def test_findings_join_scores_of_their_document(spark):
    from tessera.plans.audit import drill_down, riskiest_document, with_scores

    findings = spark.createDataFrame([("w", "d", "n", "high", "pattern", "c"), ("w", "d", "n", "low", "url", "c"), ("w", None, "n", "low", "url", "c"), ("w", "d", "other", None, None, None)], "workspace_id string, source_dated_partition string, display_name string, severity string, finding_type string, category string")
    documents = spark.createDataFrame([("w", "d", "n", 90, 10, "because", "i1"), ("w", None, "n", 99, 1, "undated", "i2"), ("w", "d", "none", 5, 5, "no findings", "i3")], "workspace_id string, source_dated_partition string, display_name string, exfiltration_risk_score int, external_resource_access_score int, top_rationale string, notebook_id string")
    got = [(r["severity"], r["exfiltration_risk_score"], r["top_rationale"]) for r in with_scores(findings, documents).collect()]
    assert sorted(got[:2]) == [("high", 90, "because"), ("low", 90, "because")] and sorted(got[2:], key=str) == [("low", None, None), (None, None, None)]
    chunks = spark.createDataFrame([("i1", 0, None), ("i2", 1, None), ("i2", 0, None)], "notebook_id string, chunk_index int, assessed_at timestamp")
    assert [tuple(r)[:2] for r in drill_down(chunks, riskiest_document(documents)).collect()] == [("i2", 0), ("i2", 1)]


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_quantiles_of_a_hot_group(spark, threshold):
    import statistics

    rng = random.Random(6)
    data = [("hot", round(rng.gauss(0, 50), 2)) for _ in range(4000)] + [("hot", 3.0)] * 2000 + [("two", 1.0), ("two", 4.0), ("one", 7.0), (None, 2.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r["g"]: (r["p50"], r["p95"], r["p99"]) for r in exclusive_quantiles(df, "v", (0.5, 0.95, 0.99), ["g"]).collect()}
        values = [v for g, v in data if g == "hot"]
        cuts = statistics.quantiles(values, n=100, method="exclusive")
        assert got["hot"] == pytest.approx((cuts[49], cuts[94], cuts[98])) and got["two"] == pytest.approx((2.5, 4.0, 4.0)) and got["one"] == (7.0,) * 3 and got[None][0] == 2.5 and "none" not in got
        everything = exclusive_quantiles(df, "v", (0.5,)).collect()
        assert [r["p50"] for r in everything] == pytest.approx([statistics.median([v for _, v in data if v is not None])])
        assert exclusive_quantiles(df.limit(0), "v", (0.5,)).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
