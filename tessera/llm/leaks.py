"""Evaluation passages in training documents.

A passage counts when ``size`` successive words of an item stand in a document
with at most a tenth of them changed, added or left out.  Both sides are cut
into item-sized windows at every word.  The CGK embedding walks through a window
and turns word edits into few differing symbols; sampling symbols of several
independent walks gives hash keys under which similar windows meet.  Every
meeting is then verified by exact edit distance.  Equal windows, of items as of documents, meet and are verified
once; what they find is handed to all of their owners afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import Vocabulary, plain, tokens
from tessera.session import table

#: Item words in one block; a larger set of items is searched block by block.
BLOCK_WORDS = 2_000_000
#: Document words handled at once inside a task.
BATCH_WORDS = 400_000
#: Meetings verified at once inside a task.
BATCH_MEETINGS = 2_000_000
_BITMAP = 1 << 22


@dataclass(frozen=True)
class Settings:
    """``walks`` independent walks of 3 * ``size`` steps, of which ``samples`` are the key.

    Measured: a single window of 20 words with two random edits meets its item in at least one of
    the walks in 0.96 of all cases; a passage longer than one window has several tries (see tests).
    """

    size: int = 20
    walks: int = 12
    samples: int = 7
    seed: int = 7

    @property
    def errors(self) -> int:
        return self.size // 10


class Walks:
    """The shared randomness: a step bit for every (walk, step, word), and the sampled steps of every walk."""

    def __init__(self, s: Settings, n_words: int) -> None:
        rng = np.random.default_rng(s.seed)
        self.s, self.steps = s, 3 * s.size
        # 64 bits per word hold the step bits of one walk; 3 * size may not exceed them
        if self.steps > 64:
            raise ValueError("size may be at most 21 words")
        self.bits = rng.integers(0, 2**63, size=(s.walks, n_words + 1), dtype=np.int64).astype(np.uint64) ^ (rng.integers(0, 2, size=(s.walks, n_words + 1)).astype(np.uint64) << np.uint64(63))
        self.sampled = [np.sort(rng.choice(self.steps, s.samples, replace=False)) for _ in range(s.walks)]
        self.mix = rng.integers(1, 2**62, size=(s.walks, s.samples), dtype=np.int64) * 2 + 1

    def keys(self, ids: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
        """Keys of the windows at the given starts; ``ids`` must go on for ``size`` words after each start."""
        step_bits = self.bits[walk][ids]
        at, end, key = starts.copy(), starts + self.s.size, np.zeros(len(starts), np.int64)
        wanted, k = self.sampled[walk], 0
        for j in range(int(wanted[-1]) + 1):
            inside = at < end
            here = np.minimum(at, end - 1)
            if wanted[k] == j:
                key = key * np.int64(1_000_003) + (np.where(inside, ids[here], -1) + 2) * self.mix[walk, k]
                key ^= key >> np.int64(29)
                k += 1
                if k == len(wanted):
                    break
            at = at + (((step_bits[here] >> np.uint64(j)) & np.uint64(1)).astype(np.int64) & inside)
        return key


def similar(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: int, errors: int) -> np.ndarray:
    """Whether ``size`` words of a from a_at and some words of b from b_at are within ``errors`` edits, both ends being equal words.

    A band of the edit matrix, for all pairs at once.  ``b`` must go on for size + errors words.
    """
    n, width = len(a_at), 2 * errors + 1
    far = errors + 1
    row = np.full((width, n), far, np.int8)
    for d in range(errors, width):  # row 0: b words left out before the first word of a
        row[d] = d - errors
    for i in range(size):
        word, new = a[a_at + i], np.full((width, n), far, np.int8)
        for d in range(width):
            j = i + d - errors  # column of b: cell (i + 1, j + 1)
            if j < -1:
                continue
            best = np.full(n, far, np.int8) if j < 0 else row[d] + (b[b_at + j] != word)
            if j == -1:
                best = np.full(n, min(i + 1, far), np.int8)
            if d + 1 < width:
                best = np.minimum(best, row[d + 1] + 1)
            if d > 0:
                best = np.minimum(best, new[d - 1] + 1)
            new[d] = np.minimum(best, far)
        row = new
    ok = np.zeros(n, bool)
    last = a[a_at + size - 1]
    for d in range(width):
        ok |= (row[d] <= errors) & (b[b_at + size - 1 + d - errors] == last)
    return ok & (a[a_at] == b[b_at])


class Index:
    """The windows of one block of items, ready to be met by document windows."""

    def __init__(self, items: list[tuple[int, str]], s: Settings) -> None:
        self.s, known = s, {}
        parts, self.item, starts, owner = [], [i for i, _ in items], [], []
        at = 0
        for n, (_, text) in enumerate(items):
            words = [p for p in map(plain, tokens(text)) if p]
            ids = [known.setdefault(w, len(known) + 1) for w in words]
            parts += [np.array(ids, np.int64), np.zeros(s.size + s.errors, np.int64)]
            for k in range(len(ids) - s.size + 1):
                starts.append(at + k)
                owner.append(n)
            at += len(ids) + s.size + s.errors
        self.vocabulary = Vocabulary(known)
        self.ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # one window stands for all equal ones; their items are members[bounds[w] : bounds[w + 1]]
        self.starts, of = distinct_windows(self.ids, np.array(starts, np.int64), s.size)
        both = np.unique(of * max(1, len(items)) + np.array(owner, np.int64))
        self.members = both % max(1, len(items))
        self.bounds = np.searchsorted(both, np.arange(len(self.starts) + 1) * max(1, len(items)))
        self.first = self.ids[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.walks = Walks(s, len(known))
        self.tables = []
        for w in range(s.walks if len(starts) else 0):
            keys = self.walks.keys(self.ids, self.starts, w)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))
        self.known3 = np.zeros(_BITMAP, bool)
        if len(self.ids) > 2:
            three = self._three(self.ids)
            self.known3[three[(self.ids[:-2] > 0) & (self.ids[1:-1] > 0) & (self.ids[2:] > 0)]] = True

    @staticmethod
    def _three(ids: np.ndarray) -> np.ndarray:
        return (ids[:-2] * 0x9E3779B1 + ids[1:-1] * 0x85EBCA77 + ids[2:] * 0xC2B2AE3D) >> 7 & (_BITMAP - 1)

    def windows(self, ids: np.ndarray) -> np.ndarray:
        """Starts of the windows that are worth a walk.

        Of the size - 2 word triples of a window each edit spoils at most three, so a
        window that qualifies has at least size - 2 - 3 * errors triples of some item: nothing is lost.
        """
        s = self.s
        if len(ids) < s.size + s.errors:
            return np.empty(0, np.int64)
        hit = self.known3[self._three(ids)] & (ids[:-2] > 0)
        total = np.concatenate([[0], np.cumsum(hit)])
        starts = np.flatnonzero(hit | (ids[:-2] > 0))
        starts = starts[starts + s.size + s.errors <= len(ids)]
        upto = np.minimum(starts + s.size, len(hit))
        return starts[total[upto] - total[starts] >= s.size - 2 - 3 * s.errors]

    def meetings(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct (document window, item window) pairs that share a key of any walk and begin with the same word, as a verified pair must.

        They come in batches of about BATCH_MEETINGS, however often a key occurs.
        """
        ranges = []
        for w, (keys, _) in enumerate(self.tables):
            mine = self.walks.keys(ids, starts, w)
            ranges.append((np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")))
        load = np.cumsum(sum(hi - lo for lo, hi in ranges)) if ranges else np.zeros(0, np.int64)
        first, at = ids[starts], 0
        while at < len(load):
            upto = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + BATCH_MEETINGS, "right")))
            pairs = []
            for (lo, hi), (_, order) in zip(ranges, self.tables):
                low, n = lo[at:upto], (hi - lo)[at:upto]
                doc = np.repeat(np.arange(at, upto), n)
                window = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                same = first[doc] == self.first[window]
                pairs.append(doc[same] * len(self.starts) + window[same])
            both = np.unique(np.concatenate(pairs))
            yield both // len(self.starts), both % len(self.starts)
            at = upto

    def search(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(number of the text, item id) of every text with a passage of an item."""
        gap = np.zeros(self.s.size + self.s.errors, np.int64)
        batch: list[np.ndarray] = []
        firsts: list[int] = []
        done = filled = 0
        for k, t in enumerate(texts):
            words = tokens(t)
            ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
            batch += [ids[ids >= 0], gap]
            firsts.append(filled)
            filled += len(batch[-2]) + len(gap)
            if filled >= BATCH_WORDS or k == len(texts) - 1:
                for docs, items in self._found(np.concatenate(batch), np.array(firsts)):
                    yield from ((done + d, self.item[i]) for d, i in zip(docs.tolist(), items.tolist()))
                batch, firsts, done, filled = [], [], k + 1, 0

    def _found(self, ids: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of documents and items that share a passage, each pair once, in batches of documents."""
        every = self.windows(ids)
        if not len(every) or not self.tables:
            return
        # what is verified reaches size + errors words beyond the start
        starts, of = distinct_windows(ids, every, self.s.size + self.s.errors)
        hits = [np.zeros(0, np.int64)]
        for doc, window in self.meetings(ids, starts):
            ok = similar(self.ids, self.starts[window], ids, starts[doc], self.s.size, self.s.errors)
            hits.append(doc[ok] * len(self.starts) + window[ok])
        hit = np.sort(np.concatenate(hits))
        # from distinct windows to the documents that hold them: (document, item window) pairs
        lo, hi = np.searchsorted(hit, of * len(self.starts)), np.searchsorted(hit, (of + 1) * len(self.starts))
        owner, at = np.searchsorted(firsts, every, "right") - 1, 0
        weight = np.diff(self.bounds)
        sums = np.concatenate([[0], np.cumsum(weight[hit % len(self.starts)])])
        load = np.cumsum(sums[hi] - sums[lo])
        while at < len(of):
            upto = int(np.searchsorted(load, (load[at - 1] if at else 0) + BATCH_MEETINGS, "right"))
            upto = int(np.searchsorted(owner, owner[max(at, upto - 1)], "right"))  # whole documents
            n = (hi - lo)[at:upto]
            window = hit[np.repeat(lo[at:upto], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] % len(self.starts)
            held = np.unique(np.repeat(owner[at:upto], n) * len(self.starts) + window)
            doc, window = held // len(self.starts), held % len(self.starts)
            n = weight[window]
            items = self.members[np.repeat(self.bounds[window], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            both = np.unique(np.repeat(doc, n) * len(self.item) + items)
            yield both // len(self.item), both % len(self.item)
            at = upto


def distinct_windows(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of one window of each content, and for every given start the number of the window that stands for it."""
    if not len(starts):
        return starts, starts
    content = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids.astype(np.int32), size)[starts])
    _, one, of = np.unique(content.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
    return starts[one], of.ravel().astype(np.int64)


#: The index of the block that this worker met last, so it is built once a worker and block, not once a task.
_last: dict[tuple, Index] = {}


def _index_of(number: tuple, block: list[tuple[int, str]], s: Settings) -> Index:
    if number not in _last:
        _last.clear()
        _last[number] = Index(block, s)
    return _last[number]


def leaked_items(docs: DataFrame, items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id and item_id of every document with a passage of an item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    ignored.  NULL texts, blank texts and items shorter than the passage size give no rows.
    Items come to the driver in blocks of at most BLOCK_WORDS words; all documents
    are read once for each block.  Nothing is shuffled but the result.  A passage's first and last word must be the item's own:
    an edit at its end leaves a shorter agreement.
    """
    s, spark = settings or Settings(), docs.sparkSession
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    kind = {f.name: f.dataType.simpleString() for f in items.schema}["item_id"]
    doc_kind = {f.name: f.dataType.simpleString() for f in docs.schema}["doc_id"]
    found = spark.createDataFrame([], f"doc_id {doc_kind}, item_id {kind}")
    call = uuid.uuid4().hex
    for n, block in enumerate(_blocks(items)):
        shared = spark.sparkContext.broadcast(block)

        def run(frames: Iterator[pd.DataFrame], shared=shared, number=(call, n)) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                index = _index_of(number, shared.value, s)
                rows = [(pdf["doc_id"].iloc[d], i) for d, i in index.search(list(pdf["text"]))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        found = found.unionByName(texts.mapInPandas(run, found.schema))
    return found.distinct()


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in order of their id, a block of at most BLOCK_WORDS words at a time; one block is on the driver at once."""
    rows, words = [], 0
    known = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in known.toLocalIterator():
        rows.append((r[0], r[1]))
        words += len(r[1].split())
        if words >= BLOCK_WORDS:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items they give away."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", "lang").distinct()
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents")).join(items, "item_id")


QUERIES = {"p6_found": p6_found, "p6_leaked": p6_leaked}
ORACLE: dict[str, str] = {}
