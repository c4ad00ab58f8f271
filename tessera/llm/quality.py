"""Per-document text statistics, and which documents are not prose.

Every line gets one of four labels (prose, list, table, junk) from a hidden
Markov model over line statistics: a label has several hidden states, a line's
statistics are its symbols, and the best sequence of states of a document
is found by Viterbi.  No weight is set by hand: the model is fitted on lines whose state is known because they were made so,
the whole sentences of sampled documents written anew in every way that running text comes in, and spoilt in the ways
that make junk of words.  Whether words stand in a plausible order is told by word
pairs counted in the well-formed sentences of all documents.
"""

from __future__ import annotations

import html
import pickle
import random
import re
import textwrap
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import plain
from tessera.session import table

LABELS = ("prose", "list", "table", "junk")
#: Documents up to which a pair is known from 2 and a word familiar from 4 occurrences; in a larger table both numbers grow with it.
PLAIN_DOCUMENTS = 20_000

_BULLET = re.compile(r"\s*(?:[-*•‣◦]|\d{1,3}[.)]|\[[ xX]\])\s+")
_STAMP = re.compile(r"\s*\[?(?:\d{4}-\d\d-\d\d[T ]?|\d\d:\d\d:\d\d)")
_DECOR = re.compile(r"^\s*(?:>+|//+|--|\|)\s+")
_HEADING = re.compile(r"\s*#{1,6}\s+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_EMPHASIS = re.compile(r"\*\*|__|(?<!\w)[_*](?=\S)|(?<=\S)[_*](?!\w)|`")
_OUTER = re.compile(r"__|_(?!\w)|(?:^|\W)_")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’‑-][^\W\d_]+)*|[.!?…;:,()\"“”]")
_CELL = re.compile(r"\s*[|;\t]\s*|\s+>\s+|\s{2,}|,(?=\S)")
_TIGHT = re.compile(r",\S")
_CODE = re.compile(r"\w\(|\w\.\w+\(|\w\[[\"']|^\s*(?:import|def|for|if|return|assert|from)\b.*[:(#)]|\w\s*=\s*\S|\":|^\s*[{}\[\]],?$|^\s*import ")
_END = re.compile(r"[.!?…:;]['\")\]]*\s*$")
_BREAKS = frozenset(".!?…;:,()\"“”")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20, 0x200B: None, 0xAD: None}


class _Kinds(dict):
    """The kind of every character: a letter, d digit, p punctuation of sentences, blank, s other symbol."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        k = "a" if c.isalpha() else "d" if c.isdigit() or c.isalnum() else " " if c.isspace() else "p" if c in ".,;:!?'’\"-‑…" else "s"
        self[code] = k
        return k


_KINDS = _Kinds()
_ASCII_KINDS = bytes(ord(_KINDS[c]) if c < 128 else 0 for c in range(256))


def tally(text: str) -> tuple[int, int, int, int]:
    """Numbers of blanks, symbols, digits and punctuation marks."""
    if text.isascii():
        kinds = text.encode("ascii").translate(_ASCII_KINDS)
        return kinds.count(b" "), kinds.count(b"s"), kinds.count(b"d"), kinds.count(b"p")
    wide = text.translate(_KINDS)
    return wide.count(" "), wide.count("s"), wide.count("d"), wide.count("p")


def _clean(line: str) -> str:
    """A line without quotation marks, markup and emphasis around its words."""
    if "&" in line:
        line = html.unescape(line)
    if "<" in line:
        line = _TAG.sub("", line)
    if not line.isascii():
        line = line.translate(_WIDE)
    # an underscore within a word is no emphasis
    if "*" in line or "`" in line or "_" in line and _OUTER.search(line):
        line = _EMPHASIS.sub("", line)
    return _DECOR.sub("", line)


_folded: dict[str, str] = {}


def _fold(word: str) -> str:
    """``plain`` of a word that isn't ASCII, remembered."""
    f = _folded.get(word)
    if f is None:
        if len(_folded) > 500_000:
            _folded.clear()
        f = _folded[word] = plain(word)
    return f


#: ASCII letters, hyphens and apostrophes as they are, marks apart, everything else as a blank.
_APART = {c: chr(c) if chr(c).isalpha() or chr(c) in "-'" else f" {chr(c)} " if chr(c) in _BREAKS else " " for c in range(128)}


def _tokens(line: str) -> list[str]:
    """Words in lower case, and the marks between them."""
    low = line.lower()
    if low.isascii() and "--" not in low and "''" not in low and "-'" not in low and "'-" not in low:
        found = low.translate(_APART).split()
        # a hyphen or apostrophe joins letters on both sides, else it is no part of a word
        return found if "-" not in low and "'" not in low else [w for x in found if (w := x.strip("-'"))]
    found = _TOKEN.findall(low)
    return found if line.isascii() else [w if w.isascii() or w in _BREAKS else _fold(w) for w in found]


@dataclass
class Pairs:
    """Word pairs of well-formed sentences; ``share`` of the sentences' own pairs are known ones."""

    known: frozenset = frozenset()
    words: frozenset = frozenset()
    share: float = 1.0

    @staticmethod
    def of(counts: Iterable[tuple[str, str, int]]) -> Pairs:
        pairs = {(a, b): n for a, b, n in counts}
        left, right = Counter(), Counter()
        for (a, b), n in pairs.items():
            left[a] += n
            right[b] += n
        return Pairs.chosen(pairs, left, right, left + right, sum(pairs.values()))

    @staticmethod
    def chosen(pairs: dict[tuple[str, str], int], left: dict[str, int], right: dict[str, int], words: dict[str, int], total: int, scale: float = 1.0) -> Pairs:
        """Of the counts of pairs, of words on the left, on the right and on either side, and of all pairs; pairs below 2 and words below 4 times ``scale`` needn't be there."""
        # a pair seen twice or more, and more often than its words would meet by chance
        known = {(a, b) for (a, b), n in pairs.items() if n >= 2 * scale and n * total > left[a] * right[b]}
        share = sum(pairs[p] for p in known) / total if total else 1.0
        return Pairs(frozenset(known), frozenset(w for w, n in words.items() if n >= 4 * scale), max(share, 0.05))

    def plausible(self, tokens: list[str]) -> tuple[int, float]:
        """Number of neighbours that are both familiar words, and how many of them are known pairs against the sentences' own share."""
        words = self.words
        # names and numbers in between don't count
        kept = [t for t in tokens if t in words or t in _BREAKS]
        familiar = [t in words for t in kept]
        n, hit = sum(map(and_, familiar, familiar[1:])), sum(map(self.known.__contains__, zip(kept, kept[1:])))
        return n, hit / n / self.share if n else 1.0


def sentence_pairs(text: str) -> Counter:
    """Word pairs of the lines that look like whole sentences."""
    out: Counter = Counter()
    for raw in text.split("\n"):
        if len(raw) < 30:  # cleaning only shortens
            continue
        line = _clean(raw).strip()
        if len(line) < 30 or not line[0].isupper() or not _END.search(line[-8:]) or _BULLET.match(line) or _STAMP.match(line):
            continue
        (_, marks, digits, _), tokens = tally(line), _tokens(line)
        if marks + digits > 0.05 * len(line) or _repeated([t for t in tokens if t not in _BREAKS]):
            continue
        out.update(zip(tokens, tokens[1:]))
    for pair in [x for x in out if x[0] in _BREAKS or x[1] in _BREAKS]:
        del out[pair]
    return out


def _repeated(words: list[str]) -> bool:
    """Whether most of the line's word fours were there before."""
    if len(words) < 12 or len(set(words)) > 0.6 * len(words) + 3:
        return False
    fours = list(zip(words, words[1:], words[2:], words[3:]))
    return len(set(fours)) < 0.6 * len(fours)


class Line:
    """Statistics of one line."""

    __slots__ = ("bullet", "capital", "cell_words", "cells", "code", "digits", "end", "heading", "longest", "stamp", "symbols", "text", "tokens", "words")

    def __init__(self, raw: str) -> None:
        line = _clean(raw).rstrip()
        m = _BULLET.match(line)
        h = None if m else _HEADING.match(line)
        body = line[m.end() :] if m else line[h.end() :] if h else line
        blanks, marks, digits, _ = tally(body)
        solid = max(1, len(body) - blanks)
        self.text, self.bullet, self.heading, self.stamp = body, bool(m), bool(h), bool(_STAMP.match(line))
        self.symbols, self.digits = marks / solid, digits / solid
        # code shows a symbol or one of its opening words
        self.code = bool((self.symbols or '"' in line or body.startswith(("import ", "for ", "if ", "def "))) and _CODE.search(line))
        self.tokens = _tokens(body)
        self.words = [t for t in self.tokens if t not in _BREAKS]
        self.cells = 1
        inner = body.strip()
        if "|" in inner or ";" in inner or "\t" in inner or " > " in inner or "  " in inner or "," in inner and _TIGHT.search(inner):
            self.cells = sum(1 for c in _CELL.split(inner) if c)
        self.cell_words = len(self.words) / max(1, self.cells)
        self.end, self.capital = bool(_END.search(body[-8:])), body.lstrip()[:1].isupper()
        self.longest = max(map(len, body.split()), default=0) if len(body) > 45 else 0


@dataclass(frozen=True)
class Lesson:
    """The symbols of a text's lines and their states, None where it isn't known; a mixed one has blocks of several kinds."""

    shown: list[tuple[str, ...]]
    states: list[str | None]
    mixed: bool


#: The hidden states, and the label of each: a label's lines can look in several ways.
STATES = (
    ("sentence", "prose"), ("wrapped", "prose"), ("notes", "prose"), ("plain", "prose"),
    ("bullet", "list"), ("short", "list"),
    ("cells", "table"), ("log", "table"),
    ("code", "junk"), ("blob", "junk"), ("heap", "junk"), ("again", "junk"),
)
LABEL_OF = np.array([LABELS.index(label) for _, label in STATES])
NUMBER_OF = {state: n for n, (state, _) in enumerate(STATES)}

#: What a line shows, in groups of which it shows one symbol each (an empty name stands for none), with how common each symbol is anywhere.
GROUPS: tuple[dict[str, float], ...] = (
    {"plain": 0.7, "bullet": 0.1, "stamp": 0.1, "heading": 0.1},
    {"": 0.9, "code": 0.1},
    {"symbols0": 0.6, "symbols1": 0.25, "symbols2": 0.15},
    {"digits0": 0.6, "digits1": 0.25, "digits2": 0.15},
    {"": 0.9, "cells": 0.1},
    {"": 0.95, "blob": 0.05},
    {"": 0.9, "clipped": 0.1},
    {"": 0.2, "order0": 0.1, "order1": 0.1, "order2": 0.2, "long0": 0.1, "long1": 0.1, "long2": 0.2},
    {"few": 0.35, "some": 0.3, "many": 0.35},
    {"": 0.9, "repeated": 0.1},
    {"": 0.6, "sentence": 0.4},
    {"": 0.8, "fragment": 0.2},
    {"": 0.6, "joined": 0.2, "apart": 0.2},
)
class Model:
    """The hidden Markov model: probabilities of each symbol under each state, of each change of state, and of the first state.

    Without training every state shows every symbol as often as any other, so nothing can be told.
    """

    #: What the commonness of a symbol anywhere counts for, in lines of each state; and each change of state, in changes.
    PRIOR, CHANGES = 5.0, 20.0

    def __init__(self, emit: list[dict[str, np.ndarray]] | None = None, change: np.ndarray | None = None, first: np.ndarray | None = None) -> None:
        n = len(STATES)
        self.emit = emit or [{s: np.full(n, p) for s, p in g.items()} for g in GROUPS]
        self.change = change if change is not None else np.full((n, n), 1 / n)
        self.first = first if first is not None else np.full(n, 1 / n)
        self._rows: dict[tuple[str, ...], int] = {}
        self._table = np.zeros((0, n))

    def __reduce__(self):
        return Model, (self.emit, self.change, self.first)

    def codes(self, shown: list[tuple[str, ...]]) -> np.ndarray:
        """A number for the symbols of every line; the table of ``weights`` has a row for each."""
        rows = self._rows
        return np.fromiter((rows.setdefault(s, len(rows)) for s in shown), np.int64, len(shown))

    def weights(self) -> np.ndarray:
        """Log probability of each numbered set of symbols under every state."""
        new = list(self._rows)[len(self._table) :]
        if new:
            each = np.array([sum(np.log(g[s]) for g, s in zip(self.emit, shown)) for shown in new])
            self._table = np.concatenate([self._table, each])
        return self._table

    @staticmethod
    def fitted(lessons: Iterable[Lesson]) -> Model:
        """The model counted from lessons: symbols from plain ones, changes of state from mixed ones."""
        n = len(STATES)
        emit = [{s: np.full(n, Model.PRIOR * p) for s, p in g.items()} for g in GROUPS]
        change, first = np.full((n, n), Model.CHANGES / n), np.full(n, Model.CHANGES / n)
        for x in lessons:
            known = [(shown, NUMBER_OF[s] if s else -1) for shown, s in zip(x.shown, x.states)]
            if x.mixed:
                first[known[0][1]] += 1
                for (_, a), (_, b) in zip(known, known[1:]):
                    change[a, b] += 1
            else:
                for shown, k in known:
                    if k >= 0:
                        for g, s in zip(emit, shown):
                            g[s][k] += 1
        whole = [sum(g.values()) for g in emit]
        return Model([{s: c / w for s, c in g.items()} for g, w in zip(emit, whole)], change / change.sum(1, keepdims=True), first / first.sum())

    @staticmethod
    def trained(taught: list[list[Lesson]]) -> Model:
        """The model fitted on the lessons of all documents, and again without those of documents whose own sentences it takes for anything but prose."""
        model = Model.fitted(x for lessons in taught for x in lessons)
        own = [[model.codes(x.shown) for x in lessons if x.states[0] == "sentence" and not x.mixed] for lessons in taught]
        paths = model.viterbi([c for cs in own for c in cs])
        kept, at = [], 0
        for lessons, cs in zip(taught, own):
            path = np.concatenate([np.zeros(0, np.int64), *paths[at : at + len(cs)]])
            at += len(cs)
            good = not len(path) or (LABEL_OF[path] == LABELS.index("prose")).mean() > 0.5
            kept += [x for x in lessons if good or None in x.states]
        return Model.fitted(kept)

    def viterbi(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """The best states of every document's lines, all documents step by step together."""
        if not codes:
            return []
        weights, change = self.weights(), np.log(self.change)
        order = sorted(range(len(codes)), key=lambda d: -len(codes[d]))
        lengths = np.array([len(codes[d]) for d in order])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate([codes[d] for d in order]) if lengths[0] else np.zeros(0, np.int64)
        came, best = [], np.zeros((0, len(STATES)))
        ends = np.zeros(len(codes), np.int64)
        for t in range(lengths[0] if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -t, "left"))
            row = weights[flat[starts[:live] + t]]
            if t == 0:
                best = np.log(self.first) + row
            else:
                through = best[:live, :, None] + change
                came.append(through.argmax(1).astype(np.uint8))
                best = through.max(1) + row
            done = int(np.searchsorted(-lengths, -(t + 1), "left"))  # documents that go on
            ends[done:live] = best[done:live].argmax(1)
        paths = np.zeros(len(flat), np.int64)
        state = np.zeros(0, np.int64)
        for t in range(int(lengths[0]) - 1, -1, -1):
            live = int(np.searchsorted(-lengths, -t, "left"))
            state = np.concatenate([state, ends[len(state) : live]])
            paths[starts[:live] + t] = state
            if t:
                state = came[t - 1][np.arange(live), state].astype(np.int64)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(codes)
        for row, d in enumerate(order):
            out[d] = paths[starts[row] : starts[row + 1]]
        return out


def _order(n: int, order: float, clipped: bool) -> str:
    """How well the words follow each other; many words tell it more surely than few."""
    if n < 3:
        return ""
    if n < 12 or clipped:
        return "order0" if order < 0.45 else "order1" if order < 0.7 else "order2"
    return "long0" if order < 0.5 else "long1" if order < 0.6 else "long2"


def symbols(lines: list[Line], pairs: Pairs) -> list[tuple[str, ...]]:
    """The symbols that each line shows."""
    seen = Counter(tuple(x.words) for x in lines) if len(lines) > 2 else {}
    out = []
    for i, x in enumerate(lines):
        w = len(x.words)
        again = w > 0 and (_repeated(x.words) or len(lines) > 2 and seen[tuple(x.words)] >= 3)
        # short clauses between marks, as in hurried notes
        clipped = not again and x.end and x.capital and not x.bullet and 5 <= w <= 7 * (len(x.tokens) - w)
        n, order = pairs.plausible(x.tokens)
        # neither begins a sentence nor goes on with one
        fragment = 0 < w < 8 and not x.capital and (i == 0 or lines[i - 1].end or x.end and x.tokens[-1] in ";:")
        join = ""
        if w and not x.end and i + 1 < len(lines) and lines[i + 1].words and not lines[i + 1].bullet:
            last = next((v for v in reversed(x.words) if v in pairs.words), None)
            first = next((v for v in lines[i + 1].words if v in pairs.words), None)
            join = "joined" if (last, first) in pairs.known else "apart"
        out.append(
            (
                "stamp" if x.stamp else "bullet" if x.bullet else "heading" if x.heading else "plain",
                "code" if x.code and not x.stamp else "",
                "symbols0" if x.symbols < 0.03 else "symbols1" if x.symbols < 0.08 else "symbols2",
                "digits0" if x.digits < 0.04 else "digits1" if x.digits < 0.15 else "digits2",
                "cells" if x.cells >= 3 and x.cell_words <= 5.5 and not x.bullet else "",
                "blob" if x.longest > 45 else "",
                "clipped" if clipped else "",
                _order(n, order, clipped),
                "few" if w < 4 else "some" if w < 8 else "many",
                "repeated" if again else "",
                "sentence" if x.end and x.capital and w >= 5 and not x.bullet else "",
                "fragment" if fragment else "",
                join,
            )
        )
    return out


def lines_of(text: str) -> tuple[list[str], list[Line]]:
    """The lines that aren't blank, as they are and measured."""
    raws = [raw for raw in text.split("\n") if raw and not raw.isspace()]
    return raws, [Line(raw) for raw in raws]


def label_documents(texts: list[str], pairs: Pairs, model: Model) -> Iterator[list[tuple[Line, int, int]]]:
    """(line, characters, label) of every line that isn't blank, for each text; texts are taken in groups of about GROUP_LINES lines."""
    held: list[tuple[list[str], list[Line], np.ndarray]] = []
    lines_held = 0
    for k, text in enumerate(texts):
        raws, lines = lines_of(text)
        held.append((raws, lines, model.codes(symbols(lines, pairs))))
        lines_held += len(lines)
        if lines_held >= GROUP_LINES or k == len(texts) - 1:
            paths = model.viterbi([c for _, _, c in held])
            for (raws_, lines_, _), path in zip(held, paths):
                yield [(x, len(raw.strip()), label) for x, raw, label in zip(lines_, raws_, LABEL_OF[path].tolist())]
            held, lines_held = [], 0


def _is_sentence(line: Line) -> bool:
    return line.end and line.capital and len(line.words) >= 5 and not (line.bullet or line.stamp or line.heading or line.code) and line.cells < 3 and line.symbols < 0.03 and line.digits < 0.04 and line.longest <= 45


def _wrapped(words: list[str], width: int) -> str:
    return textwrap.fill(" ".join(words), width, break_long_words=False, break_on_hyphens=False)


def examples(text: str, pairs: Pairs) -> list[tuple[str, list[str | None], bool]]:
    """Labelled examples from one document: texts, the state of each of their lines (None where it isn't known), and whether they are mixed.

    The document itself teaches the lines whose form leaves no doubt.  Its whole sentences are written anew in every way that
    running text comes in (one a line, wrapped, without punctuation, as clipped notes), and spoilt in the ways that make junk of
    words: shuffled, and a phrase said over and over.
    """
    raws, lines = lines_of(text)
    if not lines:
        return []
    forms: list[str | None] = []
    for x in lines:
        w = len(x.words)
        form = "log" if x.stamp else "code" if x.code and x.symbols >= 0.03 else "blob" if x.longest > 45 else None
        form = form or ("bullet" if x.bullet else "cells" if x.cells >= 3 and x.cell_words <= 5.5 else "short" if 0 < w < 4 and not x.end and x.symbols < 0.03 else None)
        forms.append(form)
    out: list[tuple[str, list[str | None], bool]] = [("\n".join(raws), forms, False)] if any(forms) else []
    whole = [_clean(raw).strip() for raw, x in zip(raws, lines) if _is_sentence(x)]
    sentences = list(dict.fromkeys(s.strip() for line in whole for s in re.split(r"(?<=[.!?…])\s+", line) if len(s.split()) >= 5))
    if len(sentences) < 2:
        return out
    draw = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    # sentences in no better order than their own words shuffled are none, and teach nothing
    heaps = [" ".join(draw.sample(w, len(w))) for w in (x.split() for x in sentences)]
    real, shuffled = (pairs.plausible([t for x in xs for t in [*_tokens(x), "."]])[1] for xs in (sentences, heaps))
    if real < (1 + shuffled) / 2:
        return out
    draw.shuffle(sentences)
    sentences = sentences[:12]
    words = " ".join(sentences).split()
    bare = [b for w in words if (b := w.strip(".,;:!?…\"'()").lower())]
    add = lambda t, state: out.append((t, [state] * (t.count("\n") + 1), False))
    add("\n".join(sentences), "sentence")
    add(" ".join(sentences), "sentence")
    add(_wrapped(words, draw.randrange(24, 90)), "wrapped")
    add(_wrapped(bare, draw.randrange(24, 90)), "plain")
    add(" ".join(bare), "plain")
    add("\n".join(" ".join(bare[i : i + 15]) for i in range(0, len(bare), 15)), "plain")
    clauses = [" ".join(bare[i : i + 5]).capitalize() + "." for i in range(0, len(bare), 5)]
    add("\n".join(" ".join(clauses[i : i + 3]) for i in range(0, len(clauses), 3)), "notes")
    cut = [" ".join(bare[at : at + draw.randrange(2, 7)]) for at in (draw.randrange(len(bare)) for _ in range(10))]
    add("\n".join(cut), "short")
    add("\n".join(c + ";" for c in cut), "short")
    apart = draw.choice((";", " | ", "\t", ","))
    add("\n".join(apart.join([*draw.sample(cut, 3), str(draw.randrange(100))]) for _ in range(6)), "cells")
    draw.shuffle(bare)
    add(" ".join(bare), "heap")
    add(_wrapped(bare, draw.randrange(24, 90)), "heap")
    spoilt = [" ".join(bare[i : i + 12]).capitalize() + "." for i in range(0, len(bare), 12)]
    add("\n".join(spoilt), "heap")
    add(_wrapped(" ".join(spoilt).split(), draw.randrange(24, 90)), "heap")
    half = len(bare) // 2
    add("\n".join(" ".join(b).capitalize() + "." for b in (bare[:half], bare[half:])), "heap")
    phrase = draw.choice(sentences)
    short = " ".join(phrase.split()[: draw.randrange(3, 9)])
    add("\n".join([phrase] * draw.randrange(5, 12)), "again")
    add(" ".join([phrase] * draw.randrange(5, 12)), "again")
    add(" ".join([short] * draw.randrange(8, 30)), "again")
    add("\n".join([short] * draw.randrange(5, 30)), "again")
    # as documents have it: blocks of every kind one after the other, in which the changes are learned
    known = [(t, states) for t, states, _ in out if None not in states]
    for _ in range(3):
        mixed: list[tuple[str, str]] = []
        for t, states in draw.sample(known, min(len(known), 8)):
            rows = list(zip(t.split("\n"), states))
            at = draw.randrange(len(rows))
            mixed += rows[at : at + draw.randrange(1, 8)]
        out.append(("\n".join(t for t, _ in mixed), [s for _, s in mixed], True))
    return out


def lessons(text: str, pairs: Pairs) -> list[Lesson]:
    return [Lesson(symbols(lines_of(t)[1], pairs), states, mixed) for t, states, mixed in examples(text, pairs)]


SHARES = "n_lines long, prose_share double, list_share double, table_share double, junk_share double"
STATS = "n_chars long, n_words long, mean_word_length double, symbol_ratio double, digit_ratio double, ending_ratio double, common_ratio double"


def shares(rows: list[tuple[Line, int, int]]) -> tuple:
    """Number of lines, and the share of their characters under each label; zeros without lines."""
    chars = [0] * 4
    for _, n, k in rows:
        chars[k] += n
    total = max(1, sum(chars))
    return (len(rows), *[c / total for c in chars])


def counts(text: str, rows: list[tuple[Line, int, int]], common: frozenset) -> tuple:
    """The statistics that need no labels; zeros for a text without lines but for its length."""
    if not rows:
        return (len(text), 0, *[0.0] * 5)
    _, marks, digits, points = tally(text)
    words = [w for x, _, _ in rows for w in x.words]
    return (
        len(text),
        len(words),
        sum(map(len, words)) / max(1, len(words)),
        (marks + points) / len(text),
        digits / len(text),
        sum(x.end for x, _, _ in rows) / len(rows),
        sum(w in common for w in words) / max(1, len(words)),
    )


#: Documents (about as many) that teach the model, and the most lines and characters of one that are taken, from a place of its own.
TRAINING_DOCUMENTS, TRAINING_LINES, TRAINING_CHARACTERS = 500, 200, 20_000
#: Lines whose labels are looked for at once inside a task.
GROUP_LINES = 20_000
#: What every model is taught beside the table's own documents, so that one without sentences has one too.
PRIMER = (
    "The clerk opened the heavy door and looked for the missing key.\nNobody had seen it since the morning, so the search went on.\nIn the end a child found it under the old bench.\n- key\n- door\n- old bench\nitem;count;price\nkey;2;3.50\ndoor;1;80.00",
    "Der Wagen hielt vor dem alten Haus am Rand der Stadt.\nEin Mann stieg aus und trug zwei Koffer hinein.\nNiemand wusste, wie lange er bleiben wollte.\n1. Koffer\n2. Wagen\nx = load(path, mode=3)\ny = {x: [1, 2]}",
    "Le marchand a fermé la boutique avant la tombée de la nuit.\nIl a laissé une lampe allumée derrière la vitre.\nPersonne ne comprit pourquoi il était parti si vite.\n2025-01-01 10:00:00 INFO started id=4\n2025-01-01 10:00:02 INFO ended id=4",
    "La maestra explicó la tarea y después abrió la ventana.\nLos niños escribían despacio porque hacía mucho calor.\nAl final del día nadie quería volver a casa.\n* tarea\n* ventana\nQUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODk=",
)


def segment(text: str) -> str:
    """At most TRAINING_LINES lines and TRAINING_CHARACTERS characters of a text, from a place that its own hash chooses."""
    lines = text.split("\n")
    at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(lines) - TRAINING_LINES + 1)
    return "\n".join(lines[at : at + TRAINING_LINES])[:TRAINING_CHARACTERS]


def _counter_rows(pairs: Counter) -> Iterator[tuple[str, str, str, int]]:
    left, right = Counter(), Counter()
    for (a, b), n in pairs.items():
        left[a] += n
        right[b] += n
        yield "pair", a, b, n
    for kind, ns in {"left": left, "right": right, "word": left + right, "all": {"": sum(left.values())}}.items():
        yield from ((kind, w, "", n) for w, n in ns.items())


def learn(docs: DataFrame, of: int) -> tuple[Pairs, list[str]]:
    """Word pairs of the sentences of all ``of`` documents, and the segments that teach the model, from one reading of the texts.

    What comes to the driver has at least 2 (words: 4) occurrences per PLAIN_DOCUMENTS documents,
    which bounds its number by the length of the documents, whatever their number is; segments are about TRAINING_DOCUMENTS.
    """
    scale = max(1.0, of / PLAIN_DOCUMENTS)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pairs: Counter = Counter()
            for t in pdf["text"]:
                pairs.update(sentence_pairs(t))
            taught = [("text", segment(t), "", 1) for t, chosen in zip(pdf["text"], pdf["chosen"]) if chosen]
            yield pd.DataFrame([*_counter_rows(pairs), *taught], columns=["kind", "a", "b", "n"])

    chosen = docs.where("text IS NOT NULL").select("text", (place < min(1.0, TRAINING_DOCUMENTS / max(1, of))).alias("chosen"))
    counted = chosen.mapInPandas(count, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    # a pair's words have its count on their sides at least
    found: dict[str, dict] = {kind: {} for kind in ("pair", "left", "right", "word", "all", "text")}
    needed = F.when(F.col("kind") == "word", 4 * scale).when(F.col("kind").isin("all", "text"), 0).otherwise(2 * scale)
    for kind, a, b, n in counted.where(F.col("n") >= needed).collect():
        found[kind][(a, b) if kind == "pair" else a] = n
    pairs = Pairs.chosen(found["pair"], found["left"], found["right"], found["word"], found["all"].get("", 0), scale)
    return pairs, sorted(found["text"])


def train(spark: SparkSession, pairs: Pairs, segments: list[str]) -> Model:
    """The model trained on the lessons of the segments and of PRIMER, which are made in tasks; only symbols come to the driver."""
    shared = spark.sparkContext.broadcast(pairs)
    texts = [*PRIMER, *segments]

    def teach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"n": pdf["n"], "lessons": [pickle.dumps(lessons(t, shared.value)) for t in pdf["text"]]})

    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(spark.sparkContext.defaultParallelism, "n")
    return Model.trained([pickle.loads(r["lessons"]) for r in sorted(rows.mapInPandas(teach, "n int, lessons binary").collect())])


#: Most words of a list of common ones.
MOST_WORDS = 100_000


def _common_words(common: DataFrame) -> frozenset:
    rows = common.where(F.col("word").isNotNull()).select("word").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return frozenset(plain(r[0]) for r in rows)


def text_statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, the number of lines and the share of characters under each label, and all other statistics.

    Shares are of the characters of all lines that aren't blank.  NULL, empty and blank texts
    get zeros.  Whole texts are read, once for the word pairs, of which counts are shuffled, and once for
    the labels; in between the model is trained on a bounded sample (TRAINING_DOCUMENTS).  ``common`` (word) is a fixed list of function words, at most MOST_WORDS of them.
    """
    of = docs.count()
    pairs, segments = learn(docs, of)
    model = train(docs.sparkSession, pairs, segments)
    shared = docs.sparkSession.sparkContext.broadcast((pairs, model, _common_words(common)))
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}["doc_id"]
    columns = f"{SHARES}, {STATS}"
    names = ["doc_id", *[c.split()[0] for c in columns.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, trained, usual = shared.value
        for pdf in frames:
            texts = [t or "" for t in pdf["text"]]
            labelled = label_documents(texts, known, trained)
            yield pd.DataFrame([(d, *shares(rows), *counts(t, rows, usual)) for d, t, rows in zip(pdf["doc_id"], texts, labelled)], columns=names)

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {columns}")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    return text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which less than half is running prose, from their statistics."""
    return p8_statistics(spark, sf_dir).where("n_lines > 0 AND prose_share < 0.5").select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_statistics": p8_statistics}
ORACLE: dict[str, str] = {}
