from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import topn
from tessera.llm.mixing import Draw, allocate, count_tokens, draw_of, mix, sizes_of
from tessera.llm.splitting import Tree, once, rejoined, split, split_rows
from tessera.llm.topn import top_n_per_group

# ---------------------------------------------------------------- splitting


def check(text: str, limit: int, overlap: int) -> list[str]:
    spans = split(text, limit, overlap)
    pieces = [text[max(0, a - overlap) : b] for a, b, _ in spans]
    assert "".join(text[a:b] for a, b, _ in spans) == text
    assert all(len(p) <= limit for p in pieces)
    for before, after in zip(pieces, pieces[1:]):
        assert before[-overlap:] == after[: min(overlap, len(before))] if overlap else True
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\r#,\u00e9", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_split_gives_the_text_back(text, limit, overlap):
    check(text, limit, overlap)


def test_split_prefers_cells_then_paragraphs_then_lines():
    cell = "# CELL ********************\n\n" + "line one\nline two\n\nparagraph two\n" * 3
    spans = split(cell * 4, 250, 20)
    assert all(cell[:6] == (cell * 4)[b : b + 6] for _, b, _ in spans[:-1])
    text = ("word " * 10 + "\n\n") * 6
    assert all(text[:b].endswith("\n\n") for _, b, _ in split(text, 120, 10))
    text = ("word " * 10 + "\n") * 6
    assert all(text[:b].endswith("\n") for _, b, _ in split(text, 120, 10))
    assert [len(p) for p in check("x" * 100, 40, 10)] == [40, 40, 40]
    assert split("", 10, 1) == [] and split("abc", 10, 1) == [(0, 3, "document")]
    with pytest.raises(ValueError):
        split("x", 10, 10)


def test_split_notebook_json_at_cells():
    cell = '{"cell_type": "code", "source": "a = 1\\nb = \\"{\\"\\n' + "c = 2\\n" * 10 + '"}'
    text = '{"cells": [' + ", ".join([cell] * 6) + '], "nbformat": 4}'
    assert all(text[b] == "{" for _, b, _ in split(text, 300, 20)[:-1])
    inner = split(text, 60, 5)
    assert sum(text[:b].endswith("\\n") or text[b : b + 1] == "{" for _, b, _ in inner) > 0.7 * len(inner)
    check(text, 60, 5)


def test_long_lines():
    text = "short\r\n" + "x" * 50 + "\r\n" + "y" * 49 + "\r\n" + "z" * 51
    tree = Tree(text, 49)
    tree.pieces()
    assert tree.oversized() == [0, 2, 4]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab \n\r#,"{}[]\\n', max_size=300), st.integers(5, 60), st.integers(0, 4), st.booleans())
def test_oversized_nodes_against_all_lines(text, limit, overlap, notebook):
    text = '{"cells": [' + text if notebook else text
    tree = Tree(text, limit, overlap)
    tree.pieces()
    long = [i for i, line in enumerate(text.split("\n"), 1) if len(line) - line.endswith("\r") > limit]
    assert tree.oversized() == ([0, *long] if len(text) > limit else [])


def test_subtrees_are_merged_whole_and_opened_nodes_stay_apart():
    cell = lambda n, w: f"# CELL {n} ****\n" + (w * 8 + "\n") * n
    text = cell(2, "a") + cell(2, "b") + cell(40, "c") + cell(2, "d") + cell(2, "e")
    spans = [text[a:b] for a, b, _ in split(text, 130, 10)]
    assert spans[0] == cell(2, "a") + cell(2, "b") and spans[-1] == cell(2, "d") + cell(2, "e")
    assert set("".join(spans[1:-1]).replace("# CELL 40 ****", "")) == {"c", "\n"}
    sections = "# One\n" + "x\n" * 20 + "\n## A\n" + "a\n" * 20 + "\n## B\n" + "b\n" * 20 + "\n# Two\n" + "y\n" * 20
    assert [sections[b : b + 4] for _, b, _ in split(sections, 100, 0)][:-1] == ["## B", "# Tw"] or [sections[b : b + 4] for _, b, _ in split(sections, 100, 0)][:-1] == ["## A", "## B", "# Tw"]
    items = "".join(f"- item {i}\n  more of it\n  and more\n" for i in range(10))
    assert all(items[b : b + 2] == "- " for _, b, _ in split(items, 120, 5)[:-1])


def test_pieces_join_to_the_text_again(spark):
    texts = ["", "a b " * 30, "x" * 100 + "\n" + "y" * 7, "é\r\n\r\n" * 40, "short"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "id long, t string")
    pieces = split_rows(df, "id", "t", 40, 10).where("kind = 'piece'").withColumnRenamed("number", "piece_no")
    got = {r["id"]: r for r in rejoined(pieces, "id", 10).collect()}
    assert {k: r["text"] for k, r in got.items()} == {k: t for k, t in enumerate(texts) if t}
    assert all(r["overlaps_agree"] and r["longest"] <= 40 for r in got.values()) and rejoined(pieces.limit(0), "id").count() == 0
    broken = pieces.withColumn("piece_text", F.when(F.col("piece_no") == 2, F.concat(F.lit("?"), "piece_text")).otherwise(F.col("piece_text")))
    assert not rejoined(broken, "id", 10).where("id = 1").first()["overlaps_agree"]


def test_split_rows_cases(spark):
    data = [(1, "a" * 30, "k"), (1, "a" * 30, "k"), (2, None, "k"), (3, "", None), (4, "b" * 10, None), (None, "c" * 30, None)]
    df = spark.createDataFrame(data, "id long, t string, kind string")
    got = split_rows(once(df.where("id IS NOT NULL").select("id", "t"), "id", "t"), "id", "t", 20, 5)
    assert Counter((r["id"], r["kind"]) for r in got.collect()) == {(1, "piece"): 2, (1, "document"): 1, (1, "line"): 1, (4, "piece"): 1}
    assert split_rows(df.limit(0), "id", "t").count() == 0


# ---------------------------------------------------------------- top n


def brute(data, n):
    held = {}
    for g, item, v, score, *_ in data:
        if g is not None:
            held[g, item] = max(held.get((g, item), (-1, -1)), (v, score))
    groups: dict = {}
    for (g, item), (_, score) in held.items():
        groups.setdefault(g, []).append((-score, item))
    return sorted((g, item, k + 1) for g, xs in groups.items() for k, (_, item) in enumerate(sorted(xs)[:n]))


@pytest.mark.parametrize("small, slice_rows", [(0, 10), (1, 7), (20, 100), (10**6, 100)])
def test_top_n_is_the_same_however_groups_are_split(spark, monkeypatch, small, slice_rows):
    monkeypatch.setattr(topn, "SMALLEST", small)
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"g{rng.randrange(30)}", rng.randrange(200), rng.randrange(5), rng.randrange(8), 1, 2) for i in range(2000)] + [(None, 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(data + data[:50], "g string, item int, v int, score int, count int, rank_no int")
    got = top_n_per_group(df, "g", [F.desc("score"), F.asc("item")], 3, ("item",), "v", slice_rows)
    assert got.columns == ["g", "item", "v", "score", "count", "rank_no"]
    assert rows(got.select("g", "item", "rank_no")) == sorted(brute(data, 3), key=str)


def test_top_n_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(topn, "SMALLEST", 0)
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, 5), ("b", 1, 5)], "g string, item int, score int")
    order = [F.desc_nulls_last("score"), F.asc("item")]
    assert rows(top_n_per_group(df, "g", order, 1).select("g", "item")) == [("a", 2), ("b", 1)]
    assert top_n_per_group(df, "g", order, 9, slice_rows=1).count() == 4 and top_n_per_group(df.limit(0), "g", order, 2).count() == 0
    ties = spark.createDataFrame([("a", 1, i) for i in range(100)], "g string, score int, id int")
    first = rows(top_n_per_group(ties, "g", [F.desc("score")], 3, slice_rows=9))
    assert first == rows(top_n_per_group(ties.repartition(7), "g", [F.desc("score")], 3)) and len(first) == 3


def test_heavy_groups_are_known_by_their_counts_and_spread_over_slices(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("g"), "id")
    assert rows(topn.hot_groups(df, "g", 3, 100)) == [("hot", 30)]
    plan = top_n_per_group(df, "g", [F.desc("id")], 3, slice_rows=100)._jdf.queryExecution().toString()
    assert "rangepartitioning(g" in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert topn.hot_groups(df.limit(0), "g", 3, 100).count() == 0


# ---------------------------------------------------------------- mixing


def test_allocation_meets_total_within_caps():
    take = allocate({"a": 100, "b": 50, "c": 0}, {"a": 0.2, "b": 0.5, "c": 0.3}, {"a": 2, "b": 1, "c": 5})
    assert take["c"] == 0 and take["b"] == 50 and take["a"] == pytest.approx(100)
    assert allocate({"a": 10}, {"a": 1.0}, {"a": 0})["a"] == 0 and allocate({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}
    free = allocate({"a": 100, "b": 100}, {"a": 0.25, "b": 0.75}, {"a": 9, "b": 9})
    assert free == {"a": pytest.approx(50), "b": pytest.approx(150)}


DOCS = "id long, source string, tokens long, weight double, draw double, text string"


def docs(spark, data):
    return spark.createDataFrame([(*d, 0.0, "t") for d in data], DOCS)


def planned(df, take, cap=9):
    return {s: draw_of(v, take[s], cap) for s, v in sizes_of(df, list(take)).items()}


@pytest.mark.parametrize("sized", [False, True])
def test_mix_hits_the_target_and_repeats_itself(spark, sized):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 60) for _ in range(6000)]
    data = [(i, "a" if i % 3 else "b", n, float(n) if sized else 1.0) for i, n in enumerate(sizes)] + [(9001, "a", 0, 1.0), (9002, None, 5, 1.0), (9003, "other", 5, 1.0)]
    sums = Counter()
    for _, s, n, _ in data:
        sums[s] += n
    df = docs(spark, data)
    take = {"a": sums["a"] * 1.37, "b": sums["b"] * 0.08}
    plan = planned(df, take)
    got = mix(df, plan).collect()
    assert len(got) == len(data)
    for s, d in plan.items():
        own = [r for r in got if r["source"] == s and r["tokens"]]
        assert {r["copies"] for r in own} <= {d.certain, d.certain + 1}
        assert abs(sum(r["tokens"] * r["copies"] for r in own) - take[s]) <= 30
    assert {r["copies"] for r in got if r["id"] >= 9001} == {0}
    again = {r["id"]: r["copies"] for r in mix(df.repartition(5), plan).collect()}
    assert again == {r["id"]: r["copies"] for r in got} and mix(docs(spark, []), plan).count() == 0
    mean = np.mean([r["tokens"] for r in got if r["source"] == "a" and r["copies"] == 2])
    every = [n for _, s, n, _ in data if s == "a" and n]
    # by equal weights every size has the same chance, by tokens long documents have a greater one
    assert mean == pytest.approx(np.average(every, weights=every) if sized else np.mean(every), rel=0.08)


def test_inclusion_is_in_proportion_to_size_and_large_documents_are_certain(spark):
    data = [(i, "a", 10 if i % 2 else 30, 0.0) for i in range(4000)] + [(i, "a", 4000, 0.0) for i in range(5000, 5003)]
    df = docs(spark, [(i, s, n, float(n)) for i, s, n, _ in data])
    plan = planned(df, {"a": 12_000 + 20_000.0})
    assert plan["a"].sure < 1 << 30 and plan["a"].rate * 30 < 1
    taken = [r for r in mix(df, plan).collect() if r["copies"]]
    assert sum(r["tokens"] == 4000 for r in taken) == 3
    small, large = (sum(r["tokens"] == n for r in taken) for n in (10, 30))
    # 20,000 tokens by inclusion c * size: c * 2000 * (10 * 10 + 30 * 30) = 20,000, so 200 small and 600 large ones
    assert small == pytest.approx(200, abs=45) and large == pytest.approx(600, abs=20)
    # equal weights rank by the random number alone: another order, other documents
    alike = mix(docs(spark, [(i, s, n, 1.0) for i, s, n, _ in data]), planned(docs(spark, [(i, s, n, 1.0) for i, s, n, _ in data]), {"a": 32_000.0}))
    assert {r["id"] for r in alike.collect() if r["copies"]} != {r["id"] for r in taken}


def test_draws_by_hand():
    assert draw_of([], 5.0, 2) == Draw()
    assert draw_of([(0, 100, 100.0, 1.0)], 250.0, 9) == Draw(2, 50.0, 1 << 30, 0.5)
    assert draw_of([(0, 100, 100.0, 1.0)], 250.0, 2) == Draw(2, 0.0, 1 << 30, 0.0)
    # classes of size 1 and 100: of 150 tokens the large document would need an inclusion above 1
    assert draw_of([(0, 200, 200.0, 1.0), (53, 100, 10_000.0, 100.0)], 150.0, 9) == Draw(0, 150.0, 53, 0.25)


def test_mix_weights_shift_inclusion(spark):
    df = docs(spark, [(i, "a", 10, 9.0 if i % 2 else 1.0) for i in range(4000)])
    got = mix(df, planned(df, {"a": 8000.0})).where("copies > 0").collect()
    assert len(got) == pytest.approx(800, abs=2) and sum(r["id"] % 2 for r in got) / len(got) == pytest.approx(0.9, abs=0.04)


def test_count_tokens(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",)], "t string")
    got = [r[0] for r in df.select(count_tokens(F.col("t"))).collect()]
    assert got[0] == 2 and got[1:3] == [0, 0] and got[3] > 1


def test_a_long_line_is_cut_at_a_blank_far_back():
    far = "a" * 3000 + " " + "b" * 12_000
    assert split(far, 14_000, 200) == [(0, 3001, "blank"), (3001, 15_001, "document")]
