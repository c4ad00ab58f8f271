from __future__ import annotations

import json
import math
import re
import statistics
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import jsons, literals, nested, paths, quantiles, text, urls
from tessera.functions.rule_catalogue import RULES
from tessera.functions.severity import meets, ordinal


def one(spark, schema, data, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_text_functions(spark):
    data = [("  abcdefghijklmnop ",), ("short",), ("",), (None,), ("é" * 30,)]
    c = F.col("c")
    got = one(spark, "c string", data, text.redact(c), text.trim_snippet(c, 8), text.content_hash16(c), text.safe_segment(c, 10))
    assert [g[0] for g in got] == ["abcd********mnop", "***", "", None, "éééé" + "*" * 22 + "éééé"]
    assert [g[1] for g in got] == ["abcdefg…", "short", "", "", "é" * 7 + "…"]
    assert got[2][2] == "" == got[3][2] and len(got[0][2]) == 16
    assert got[1][3] == "short" and got[2][3] == "unnamed" and got[3][3] == "unnamed"


def test_entropy(spark):
    data = ["aab", "", "abcdefgh", "ééx"]
    got = [r[0] for r in one(spark, "c string", [(d,) for d in data] + [(None,)], text.entropy(F.col("c")))]
    for d, g in zip(data, got):
        want = -sum(n / len(d) * math.log2(n / len(d)) for n in Counter(d).values()) if d else 0.0
        assert g == pytest.approx(want)
    assert got[-1] is None


def test_line_number_and_provider(spark):
    got = one(spark, "c string, n int", [("a\nb\nc", 4), ("a", 0)], text.line_number(F.col("c"), F.col("n")))
    assert [g[0] for g in got] == [3, 1]
    got = one(spark, "c string", [("/s/1/providers/Microsoft.Sql/servers/x",), ("/none",), (None,)], text.resource_provider(F.col("c")), text.api_version(text.resource_provider(F.col("c"))))
    assert got == [("Microsoft.Sql/servers", "2023-08-01-preview"), (None, "2023-09-01"), (None, "2023-09-01")]


def test_severity(spark):
    got = one(spark, "c string", [("critical",), ("low",), (None,), ("odd",)], ordinal(F.col("c")), meets(F.col("c"), "high"), meets(F.col("c"), "odd"))
    assert got == [(0, True, True), (3, False, True), (4, True, True), (4, True, True)]


def test_path_attribution(spark):
    g = "25a7d7d7-7f47-4ca5-b057-c6863860612c"
    data = [(f"/x/exports/{g}/20250106_1/a.ipynb",), ("/base/team/2025/a.py",), ("/x/Files/a.py",), (f"/base/w/20250101/{g}/20250202/a.py",), (None,)]
    got = one(spark, "p string", data, *paths.attribute(F.col("p"), "/base", "d", "D"))
    assert got == [(g, g, "20250106_1"), ("team", "team", "2025"), ("d", "D", None), ("w", "w", "20250101"), ("d", "D", None)]


def test_destination_and_resolution(spark):
    g = "25a7d7d7-7f47-4ca5-b057-c6863860612c"
    data = [("abfss://Sales@onelake.dfs.fabric.microsoft.com/x",), (f"https://api.fabric.microsoft.com/v1/workspaces/{g}/items",), (f"https://app.powerbi.com/a/groups/{g}/r",), ("https://lake.example/x",), (None,)]
    assert [r[0] for r in one(spark, "u string", data, urls.destination(F.col("u")))] == ["Sales", g, g, None, None]
    cases = [(g.upper(), "N", None, g, "s"), ("Sales", None, "id-1", "no guid", "sales"), ("Sales", None, None, None, None), (None, None, None, g, "s")]
    got = one(spark, "raw string, n string, i string, s string, sn string", cases, *urls.resolve(*[F.col(c) for c in ("raw", "n", "i", "s", "sn")]))
    assert got == [(g, "N", False), ("id-1", "Sales", False), (None, "Sales", None), (None, None, None)]


def test_address_pattern():
    found = re.findall(urls.pattern(), "see https://a.b/c?d=1, jdbc:sqlserver://x;y www.a.b/c (s3://k)")
    assert found == ["https://a.b/c?d=1", "jdbc:sqlserver://x", "www.a.b/c", "s3://k"]


def test_error_struct_and_clamp(spark):
    kind = "e struct<a:string,b:struct<c:int>>, n int"
    df = spark.createDataFrame([((None, (None,)), 500), ((None, (429,)), -20), (None, None)], kind)
    got = [tuple(r) for r in df.select(nested.error_text(df, "e"), nested.clamp(F.col("n"), 0, 100)).collect()]
    assert got[0] == (None, 100) and "429" in got[1][0] and got[1][1] == 0 and got[2] == (None, None)


def test_exclusive_quantiles(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", 7.0), ("g", None)], "k string, v double")
    got = {r["k"]: r for r in quantiles.exclusive_quantiles(df, "v", (0.25, 0.5, 0.75), ["k"]).collect()}
    assert [got["g"][c] for c in ("p25", "p50", "p75")] == pytest.approx(statistics.quantiles(values, n=4, method="exclusive"))
    assert got["h"]["p50"] == 7.0


def test_json_replacing(spark):
    data = [('{"old":["old",{"k":"x old"}],"n":1}',), ("no json",), (None,), ('{"a":"b"}',)]
    got = [r[0] for r in one(spark, "t string", data, jsons.replace_values(F.col("t"), {"old": "new"}))]
    assert json.loads(got[0]) == {"old": ["new", {"k": "x new"}], "n": 1} and got[1:] == ["no json", None, '{"a":"b"}']


def test_json_walk():
    doc = {"activities": [{"type": "Copy", "connectionReference": {"type": "Sql", "connectionId": "c1"}, "typeProperties": {"server": "s"}, "sink": {"type": "Blob", "url": "u"}}]}
    found = list(jsons.details(json.dumps(doc)))
    assert {f[1] for f in found} == {"connection_reference", "pipeline_sink"} and '"server": "s"' in found[0][2]
    deep: object = {"source": {"type": "t"}}
    for _ in range(40):
        deep = {"a": deep}
    assert list(jsons.details(json.dumps(deep))) == []
    doc = [{"linkedServiceName": "ls", "source": {"host": "h", "typeProperties": {}}, "note": {"deep": ["the Ledger"]}}]
    found = list(jsons.structure(doc, ("LEDGER",)))
    assert [f[:2] for f in found] == [("$[0]", "connection_reference"), ("$[0]", "pipeline_source"), ("$[0].note", "connection_reference")] and '"server": "h"' in found[1][2]
    assert len(next(jsons.structure({"linkedServiceName": "x" * 5000}))[4]) == 400 and list(jsons.structure(3)) == []
    assert [d[1] for d in jsons.details("Server=tcp:db.example; https://a.b/x")] == ["url", "connection_string"]


def test_rule_catalogue_invariants():
    assert len(RULES) == 104 and len({r.category for r in RULES}) >= 16 and len({r.message for r in RULES}) == 104
    assert {r.severity for r in RULES} <= {"low", "medium", "high", "critical"}


@pytest.mark.parametrize("pattern, want", [("(foo|barbaz)x+", {"foo", "barbaz"}), ("ab?c", None), ("(?:hello)?world", {"world"}), (r"\bABC[0-9]{3}", {"abc"}), ("a|b", None)])
def test_required_literals(pattern, want):
    got = literals.required(pattern)
    assert (set(got) if got else None) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="pasword=:'\"x1AKIbearer ", max_size=60))
def test_required_literals_lose_no_match(s):
    for r in RULES:
        need = literals.required(r.inline)
        if need and re.search(r.inline, s):
            assert any(w in literals.lower(s) for w in need)
