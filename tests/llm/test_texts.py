from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from conftest import rows

from tessera.llm import quality as q
from tessera.llm.leaks import Index, Settings, Walks, leaked_items, similar
from tessera.llm.words import Vocabulary, plain, tokens

# ---------------------------------------------------------------- words


@pytest.mark.parametrize("a, b", [("Ａｆｔｅｒ the", "after THE"), ("l'entrepôt", "L’ENTREPOT"), ("**bold** <b>x</b>&nbsp;y", "bold x y"), ("audit-\n> table", "audit‑table"), ("wou\u200bld", "would"), ("hiér", "hier")])
def test_same_words(a, b):
    words = lambda t: [p for p in map(plain, tokens(t)) if p]
    assert words(a) == words(b)


def test_vocabulary_starts_anew_when_full(monkeypatch):
    v = Vocabulary({"a": 1})
    monkeypatch.setattr(Vocabulary, "MOST", 3)
    assert [v[w] for w in ("A,", "b", "--", "c", "a")] == [1, 0, -1, 0, 1] and len(v) <= 3


# ---------------------------------------------------------------- leaks

rng = random.Random(2)
VOCAB = [f"w{i}" for i in range(400)]


def passage(n):
    return [rng.choice(VOCAB) for _ in range(n)]


ITEMS = [(i, " ".join(passage(rng.randrange(30, 90)))) for i in range(30)] + [(99, " ".join(passage(12)))]


def edited(words, errors):
    out = list(words)
    for _ in range(errors):
        at, kind = rng.randrange(1, len(out) - 1), rng.randrange(3)
        if kind == 0:
            out[at] = "changed"
        elif kind == 1:
            out.insert(at, "added")
        else:
            del out[at]
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similar_against_edit_distance():
    s = Settings()
    for _ in range(300):
        a = np.array([rng.randrange(5) + 1 for _ in range(20)])
        b = np.array([int(x) if isinstance(x, (int, np.integer)) else 9 for x in edited(a.tolist(), rng.randrange(5))] + [0] * 10)
        want = any(distance(a.tolist(), b[:n].tolist()) <= 2 and b[n - 1] == a[-1] for n in range(18, 23)) and a[0] == b[0]
        assert similar(a, np.array([0]), b, np.array([0]), s.size, s.errors)[0] == want


def documents():
    data, want = [], set()
    for d in range(400):
        body = passage(rng.randrange(0, 200))
        if d % 4 == 0:
            item, text = ITEMS[rng.randrange(30)]
            words = text.split()
            n = rng.randrange(26, min(60, len(words)) + 1)
            k = rng.randrange(len(words) - n + 1)
            at = rng.randrange(len(body) + 1)
            body[at:at] = edited(words[k : k + n], n // 13)
            want.add((d, item))
        elif d % 4 == 1:
            words = ITEMS[rng.randrange(30)][1].split()
            body[0:0] = words[3:18]  # a shorter agreement
        data.append((d, " ".join(body)))
    return data, want


def test_leaks_are_found_and_shorter_agreements_are_not(spark):
    data, want = documents()
    loud = [(d, t.upper().replace(" ", ", " if d % 3 else " \n> ")) for d, t in data]
    df = spark.createDataFrame([(*x, "x", 1) for x in loud] + [(1000, None, "x", 1), (1001, "  ", "x", 1)], "doc_id long, text string, item_id string, lang int")
    items = spark.createDataFrame([(i, t, "y") for i, t in ITEMS] + [(500, None, "y"), (501, "", "y"), (0, ITEMS[0][1], "y")], "item_id long, text string, doc_id string")
    got = set(rows(leaked_items(df, items)))
    assert len(got & want) >= 0.99 * len(want) and got - want == set()
    assert leaked_items(df.limit(0), items).count() == 0 and leaked_items(df, items.limit(0)).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    import tessera.llm.leaks as leaks

    data, _ = documents()
    df, items = spark.createDataFrame(data[:100], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = rows(leaked_items(df, items))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 400)
    assert rows(leaked_items(df, items)) == whole and whole


def test_one_window_meets_its_item():
    s, n = Settings(), 1000
    walks, met = Walks(s, n), 0
    draw = np.random.default_rng(0)
    for _ in range(150):
        a = draw.integers(1, n, 20)
        b = np.array([int(x) if not isinstance(x, str) else 1 for x in edited(a.tolist(), 2)] + [0] * 30)
        a = np.concatenate([a, np.zeros(30, int)])
        met += any(walks.keys(a, np.array([0]), w)[0] == walks.keys(b, np.array([0]), w)[0] for w in range(s.walks))
    assert met >= 0.9 * 150


def test_many_items_and_documents_share_a_passage(spark, monkeypatch):
    import tessera.llm.leaks as leaks

    shared = " ".join(passage(30))
    items = [(i, shared if i % 2 else shared + f" own{i} words{i}") for i in range(10_000)] + [(20_000, " ".join(passage(40)))]
    index = Index(items, Settings())
    assert len(index.starts) < 22 + 3 * 5000 + 21 and len(index.members) >= 10_000 * 11
    texts = [" ".join(edited(shared.split(), 1)), "nothing", "a b " + shared, shared, " ".join(passage(30)), shared]
    for batch in (100_000, 2_000_000):
        monkeypatch.setattr(leaks, "BATCH_MEETINGS", batch)
        got = list(index.search(texts))
        assert len(got) == len(set(got)) and {d for d, _ in got} == {0, 2, 3, 5}
        assert all({i for k, i in got if k == d} == set(range(10_000)) for d in (0, 2, 3, 5))


@pytest.mark.parametrize("kind", ["change", "insert", "delete", "two changes", "change and insert"])
def test_recall_by_kind_of_edit(kind):
    index, found = Index(ITEMS[:30], Settings()), 0
    for n in range(100):
        item, text = ITEMS[n % 30]
        words = text.split()
        at = rng.randrange(len(words) - 22 + 1)
        part, p = words[at : at + 22], rng.randrange(3, 19)
        if kind != "insert" and kind != "delete":
            part[p] = "changed"
        if "insert" in kind:
            part.insert(p - 1, "added")
        if kind == "delete":
            del part[p]
        if kind == "two changes":
            part[(p + 7) % 16 + 2] = "other"
        found += (0, item) in set(index.search([" ".join(passage(5) + part + passage(30))]))
    assert found >= 90


def test_an_edit_at_the_end_leaves_a_shorter_agreement():
    item, text = max(ITEMS, key=lambda x: len(x[1]))
    words, index = text.split()[:20], Index([(item, text)], Settings())
    assert list(index.search([" ".join(words + ["x"] * 30)])) == [(0, item)]
    assert list(index.search([" ".join(["changed", *words[1:]] + ["x"] * 30)])) == list(index.search([" ".join(words[:19] + ["x"] * 30)])) == []


def test_the_gate_loses_no_window():
    ix = Index(ITEMS, Settings())
    for _ in range(200):
        words = ITEMS[rng.randrange(30)][1].split()
        k = rng.randrange(len(words) - 20 + 1)
        ids = np.array([ix.vocabulary[w] for w in passage(10) + edited(words[k : k + 20], 2) + passage(40)])
        assert 10 in ix.windows(ids)


# ---------------------------------------------------------------- quality


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(1)
    n = len(q.STATES)
    for lengths in ([1], [2, 4, 3], [4, 0, 1, 4]):
        m = q.Model(change=draw.dirichlet(np.ones(n), n), first=draw.dirichlet(np.ones(n)))
        m._rows, m._table = {(str(i),): i for i in range(6)}, draw.normal(0, 3, (6, n))
        codes = [draw.integers(0, 6, k) for k in lengths]
        for c, path in zip(codes, m.viterbi(codes)):
            value = lambda p: (np.log(m.first[p[0]]) if p else 0) + sum(m._table[x][k] for x, k in zip(c, p)) + sum(np.log(m.change[a, b]) for a, b in zip(p, p[1:]))  # noqa: E731, B023
            assert len(path) == len(c) and value(path.tolist()) == pytest.approx(max(map(value, itertools.product(range(n), repeat=len(c)))))
    assert q.Model().viterbi([]) == [] and [len(p) for p in q.Model().viterbi([np.zeros(0, np.int64)])] == [0]


SUBJECTS, VERBS, OBJECTS, ENDS = ("auditor", "pipeline", "report", "vault"), ("checked", "moved", "copied"), ("ledger", "quota", "archive"), ("after the review", "without any warning", "near the limit")


def sentence():
    return f"The {rng.choice(SUBJECTS)} {rng.choice(VERBS)} the {rng.choice(OBJECTS)} {rng.choice(ENDS)}."


PROSE = [" ".join(sentence() for _ in range(5)) for _ in range(60)]
WRAPPED = "\n".join(["The auditor checked the ledger after the", "review. The vault moved the quota without", "any warning. The report copied the archive", "near the limit."])
KINDS = {
    "list": "\n".join(f"- {rng.choice(OBJECTS)} {i}" for i in range(20)),
    "table": "\n".join(f"{rng.choice(OBJECTS)},{i},Approved,{i / 7:.2f}" for i in range(20)),
    "junk": "\n".join("path = load(\"x\", mode=%d)  # {y}" % i for i in range(20)),
    "log": "\n".join(f"2025-01-{i + 1:02d}T10:00:00Z INFO [vault] id={i} status=200" for i in range(20)),
    "heap": " ".join(rng.choice(SUBJECTS + OBJECTS) for _ in range(80)),
    "again": "this is the end of the list " * 30,
}


@pytest.fixture(scope="module")
def pairs():
    counts: dict = {}
    for t in PROSE:
        for k, n in q.sentence_pairs(t).items():
            counts[k] = counts.get(k, 0) + n
    return q.Pairs.of((a, b, n) for (a, b), n in counts.items())


@pytest.fixture(scope="module")
def model(pairs):
    return q.Model.trained([q.lessons(t, pairs) for t in [*q.PRIMER, *PROSE]])


def label(text, pairs, model):
    return next(q.label_documents([text], pairs, model))


def test_weights_are_probabilities_and_nothing_is_known_without_training(pairs, model):
    for m in (model, q.Model(), q.Model.trained([])):
        assert all(sum(g.values()) == pytest.approx(np.ones(len(q.STATES))) for g in m.emit) and m.change.sum(1) == pytest.approx(1) and m.first.sum() == pytest.approx(1)
    untrained = [{k for _, _, k in label(t, pairs, q.Model())} for t in [*PROSE[:5], *KINDS.values()]]
    assert all(x == untrained[0] for x in untrained)  # every text gets the same label
    assert (model.__reduce__()[0](*model.__reduce__()[1]).change == model.change).all()


def test_lessons_have_a_state_for_every_line(pairs):
    for t in [*PROSE, *q.PRIMER, *KINDS.values(), "x", "\u2028\x0b a\x0cb. C d e f g h.\x85" * 9, "One two three four five. " * 400]:
        for text, states, mixed in q.examples(t, pairs):
            assert len(states) == len(q.lines_of(text)[0]) and (not mixed or None not in states)
    assert q.examples("", pairs) == [] and {s for _, states, _ in q.examples(PROSE[0], pairs) for s in states} >= {"sentence", "wrapped", "plain", "notes", "short", "cells", "heap", "again"}


def test_heaps_and_repetitions_in_sentences_form_teach_no_prose(pairs):
    words = PROSE[0].replace(".", "").lower().split()
    for t in ("\n".join(" ".join(rng.sample(words, 14)).capitalize() + "." for _ in range(6)), "\n".join([PROSE[0].split(". ")[0] + "."] * 9)):
        assert not {s for _, states, _ in q.examples(t, pairs) for s in states} & {"sentence", "wrapped", "plain", "notes"}


@pytest.mark.parametrize("line", ["checked the ledger after", "The auditor moved", "vault moved quota near limit"])
def test_the_chain_decides_lines_that_mislead(pairs, model, line):
    """Among list entries a line that looks like prose or junk by itself is an entry too."""
    entries = ["the ledger", "the quota", "a vault", "the report", "copied"]
    text = "\n".join([*entries, line, *entries])
    of = lambda m: next(q.LABELS[k] for x, _, k in label(text, pairs, m) if x.text == line)
    assert of(model) == "list" and of(q.Model(model.emit)) != "list"  # without it every change of state is as likely as any other


def test_groups_of_documents_change_nothing(pairs, model, monkeypatch):
    texts = [*PROSE[:8], "", WRAPPED, *KINDS.values(), "  "]
    whole = [[k for _, _, k in rows] for rows in q.label_documents(texts, pairs, model)]
    for lines in (1, 7):
        monkeypatch.setattr(q, "GROUP_LINES", lines)
        assert [[k for _, _, k in rows] for rows in q.label_documents(texts, pairs, model)] == whole
    assert list(q.label_documents([], pairs, model)) == []


def test_segments_are_bounded():
    text = "\n".join(f"line {i}" for i in range(10_000))
    assert q.segment(text) in text and q.segment(text).count("\n") == q.TRAINING_LINES - 1 and len(q.segment("x" * 10**6)) == q.TRAINING_CHARACTERS and q.segment("") == ""


@pytest.mark.parametrize("kind", KINDS)
def test_not_prose(pairs, model, kind):
    assert q.shares(label(KINDS[kind], pairs, model))[1] < 0.5


@pytest.mark.parametrize("text", [PROSE[0], WRAPPED, PROSE[1].lower().replace(".", ""), "> " + WRAPPED.replace("\n", "\n> "), "**" + PROSE[2].replace(" ", "&nbsp;", 3) + "**", PROSE[3] + "\n\n- one\n- two"])
def test_prose(pairs, model, text):
    assert q.shares(label(text, pairs, model))[1] > 0.5


def test_statistics_of_a_text(spark):
    data = [(i, t) for i, t in enumerate(PROSE)] + [(100, None), (101, " \n "), (102, KINDS["table"]), (103, "x" * 200_000), (104, "The end. " * 30_000), (None, "A b c.")]
    df = spark.createDataFrame([(*d, 1.0, "en") for d in data], "doc_id long, text string, prose_share double, word string")
    common = spark.createDataFrame([("the", "en"), ("The", "xx"), (None, None)], "word string, doc_id string")
    got = {r["doc_id"]: r for r in q.text_statistics(df, common).collect()}
    assert len(got) == len(data) and got[100]["n_chars"] == 0 and got[101]["n_lines"] == 0 and got[101]["prose_share"] == 0
    assert got[0]["common_ratio"] > 0.2 and got[0]["ending_ratio"] == 1.0 and got[0]["prose_share"] == 1.0 and got[102]["table_share"] == 1.0
    assert got[103]["prose_share"] < 0.5
    assert q.text_statistics(df.limit(0), common.limit(0)).count() == 0


def test_pairs_come_from_all_documents_and_are_alike_at_every_size(spark):
    texts = [sentence() for _ in range(300)]
    counts: dict = {}
    for t in texts:
        for pair, n in q.sentence_pairs(t).items():
            counts[pair] = counts.get(pair, 0) + n
    whole = q.Pairs.of((a, b, n) for (a, b), n in counts.items())
    docs = lambda times: spark.createDataFrame([(i, t) for i, t in enumerate(texts * times)] + [(-1, None)], "doc_id long, text string")
    assert len(whole.known) > 20
    assert q.learn(docs(1), 20_000)[0] == whole
    assert q.learn(docs(3), 60_000)[0] == whole
    often = {pair for pair in whole.known if counts[pair] >= 60}
    assert 0 < len(often) < len(whole.known) and q.learn(docs(1), 600_000)[0].known == often
    assert q.learn(docs(0), 0) == (q.Pairs(), [])
    # a small source among many documents, with ids of high hashes: none of its texts may be passed over
    rare = spark.range(-100, -1).where("pmod(xxhash64(id), 1 << 30) >= 1 << 29").limit(10).selectExpr("id AS doc_id", "'The heron watches the quiet estuary at dawn.' AS text")
    got = q.learn(docs(1).unionByName(rare), 100_000)[0]
    assert rare.count() == 10 and ("heron", "watches") in got.known and "heron" in got.words


def test_too_many_common_words_are_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The end.")], "doc_id long, text string")
    common = spark.createDataFrame([("the",), ("The",), ("a",), ("a",), (None,)], "word string")
    monkeypatch.setattr(q, "MOST_WORDS", 3, raising=False)
    assert q.text_statistics(docs, common).count() == 1
    monkeypatch.setattr(q, "MOST_WORDS", 2, raising=False)
    with pytest.raises(ValueError):
        q.text_statistics(docs, common)
