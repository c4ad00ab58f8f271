"""Splitting oversized texts at natural boundaries.

A text is parsed into a tree of spans: document, cells (or sections under headings of growing depth), paragraphs, blocks (a line
and what is indented below it: list items, functions), lines, and in JSON the lines within strings.  The tree is packed bottom-up: whole sibling subtrees are merged while they fit together,
and only a node that is itself too large is opened, its pieces never being joined with those of its siblings.
A leaf that is still too large is cut at blanks, and only where there is none anywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

LEVELS = ("document", "cell", "paragraph", "block", "line", "string line")
_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
_CELL_MARK = re.compile(r"^(?:# (?:CELL|MARKDOWN|METADATA|PARAMETERS CELL|COMMAND)\b|# ?%%)", re.M)
#: Headings stand after a blank line; a comment within code doesn't.
_HEADING = re.compile(r"(?:\A|\n[ \t\r]*\n)(?=(#{1,6}) \S)")
_PARAGRAPH = re.compile(r"(?:\r?\n[ \t]*){2,}|\r(?!\n)[ \t]*\r(?!\n)")
_BLOCK = re.compile(r"(?:\r\n|\n|\r)(?=\S)")
_LINE = re.compile(r"\r\n|\n|\r")
# in JSON the source's own line ends are escaped; an escaped backslash before n is none
_JSON_PARAGRAPH = re.compile(r'(?<!\\)(?:\\\\)*(?:\\r)?(?:\\n){2,}|^\s*"(?:\\n)?",?\r?\n', re.M)
_JSON_LINE = re.compile(r"(?<!\\)(?:\\\\)*\\n")
_CHILDREN = {"paragraph": (_PARAGRAPH, _JSON_PARAGRAPH), "block": (_BLOCK, _BLOCK), "line": (_LINE, _LINE), "string line": (None, _JSON_LINE)}


@dataclass
class Node:
    """A span of the text; children are found when it is opened.  ``depth`` is that of a section's heading."""

    start: int
    end: int
    level: int
    depth: int = 0


@dataclass(frozen=True)
class Piece:
    """A packed span: what ends it, and whether it consists of whole subtrees."""

    start: int
    end: int
    boundary: str
    whole: bool


def _json_cells(text: str) -> list[int]:
    """Starts of the objects two levels down (the cells of a notebook), or nothing for another text."""
    starts, depth = [], 0
    for m in _JSON_TOKEN.finditer(text):
        c = text[m.start()]
        if c in "{[":
            if c == "{" and depth == 2:
                starts.append(m.start())
            depth += 1
        elif c in "}]":
            depth -= 1
    return starts


def _cut(node: Node, ends: Iterator[int] | list[int], level: int, depth: int = 0) -> list[Node]:
    at, out = node.start, []
    for e in ends:
        if at < e < node.end:
            out.append(Node(at, e, level, depth))
            at = e
    out.append(Node(at, node.end, level, depth))
    return out


class Tree:
    """The spans of one text; a node is opened only when it is larger than what a piece may hold."""

    def __init__(self, text: str, limit: int, overlap: int = 0) -> None:
        if not 0 <= overlap < limit:
            raise ValueError("the overlap must be less than the limit")
        self.text, self.limit, self.overlap = text, limit, overlap
        self.json = text.lstrip()[:1] in ("{", "[") and '"cells"' in text
        self.headings: list[tuple[int, int]] = []  # where they stand, and their depth
        self.leaves: list[tuple[Node, bool]] = []  # nodes that were not opened, and whether they were too large

    def children(self, node: Node) -> list[Node]:
        """The nodes of the next level within a node; itself where that level parts nothing."""
        t, level = self.text, node.level + 1
        if LEVELS[level] == "cell":
            marks = _json_cells(t) if self.json else [m.start() for m in _CELL_MARK.finditer(t)]
            if marks:
                return _cut(node, marks, level)
            self.headings = [(m.end(), len(m.group(1))) for m in _HEADING.finditer(t)]
        inner = [h for h in self.headings if node.start < h[0] < node.end] if level <= LEVELS.index("paragraph") else []
        if inner:
            depth = min(d for _, d in inner)
            return _cut(node, [at for at, d in inner if d == depth], LEVELS.index("cell"), depth)
        pattern = _CHILDREN.get(LEVELS[level], (None, None))[self.json]
        return _cut(node, [m.end() for m in pattern.finditer(t, node.start, node.end)] if pattern else [], level)

    def room(self, start: int) -> int:
        """Characters of its own that a piece may hold: all but the first begin with the overlap."""
        return self.limit - self.overlap if start else self.limit

    def pack(self, node: Node) -> list[Piece]:
        """The pieces of a subtree, its children packed before they are merged."""
        if node.end - node.start <= self.room(node.start):
            self.leaves.append((node, False))
            return [Piece(node.start, node.end, LEVELS[node.level], True)]
        if node.level + 1 == len(LEVELS):
            self.leaves.append((node, True))
            return self.cut(node)
        packed: list[Piece] = []
        for child in self.children(node):
            for piece in self.pack(child):
                before = packed[-1] if packed else None
                if before and before.whole and piece.whole and piece.end - before.start <= self.room(before.start):
                    packed[-1] = Piece(before.start, piece.end, piece.boundary, True)
                else:
                    packed.append(piece)
        # the pieces of an opened node stay apart from those of its siblings
        return [Piece(p.start, p.end, p.boundary, False) for p in packed]

    def cut(self, node: Node) -> list[Piece]:
        """A leaf in pieces that end at the last blank or comma that fits, or at the limit where there is none."""
        out, at, t = [], node.start, self.text
        while node.end - at > self.room(at):
            top = at + self.room(at)
            blank = max(t.rfind(" ", at + self.overlap, top), t.rfind(",", at + self.overlap, top))
            end = blank + 1 if blank > at + self.overlap else top
            out.append(Piece(at, end, "blank" if end < top else "cut", False))
            at = end
        return [*out, Piece(at, node.end, LEVELS[node.level], False)]

    def pieces(self) -> list[Piece]:
        self.leaves = []
        packed = self.pack(Node(0, len(self.text), 0)) if self.text else []
        out: list[Piece] = []
        for p in packed:
            # a scrap shorter than the overlap (closing brackets, blank lines) goes with its neighbour where both fit
            scrap = out and min(p.end - p.start, out[-1].end - out[-1].start) < self.overlap
            if scrap and p.end - out[-1].start <= self.room(out[-1].start):
                out[-1] = Piece(out[-1].start, p.end, p.boundary, False)
            else:
                out.append(p)
        return [*out[:-1], replace(out[-1], boundary=LEVELS[0])] if out else []

    def oversized(self) -> list[int]:
        """0 where the document exceeds the limit, and the numbers of its lines (ending at \\n, a last carriage return left out) that do so alone.

        Known from the leaves of the packed tree: a line within a leaf that fits is short itself, so only lines
        that leave their leaf, or fill one that was cut, are measured.
        """
        t, out = self.text, []
        if len(t) <= self.limit:
            return out
        out.append(0)
        begin = number = counted = 0  # start of the line that is open, and the line number counted so far

        def close(end: int) -> None:
            nonlocal number, counted
            if end - begin - (t[end - 1 : end] == "\r") > self.limit:
                number, counted = number + t.count("\n", counted, begin), begin
                out.append(number + 1)

        for leaf, _ in self.leaves:
            first = t.find("\n", leaf.start, leaf.end)
            if first >= 0:
                close(first)
                begin = t.rfind("\n", leaf.start, leaf.end) + 1
        close(len(t))
        return out


def split(text: str, limit: int = 14_000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """Pieces of a text as (start, end, boundary), without the overlap.

    Piece k is ``text[max(0, start - overlap):end]``: at most ``limit``
    characters, beginning with the last ``overlap`` characters of the piece before;
    the spans without overlap join to exactly the text.  An empty text has no piece.
    """
    return [(p.start, p.end, p.boundary) for p in Tree(text, limit, overlap).pieces()]


def split_rows(df: DataFrame, key: str, text: str, limit: int = 14_000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """One row per piece and one per oversized node of each text.

    Columns: the key, kind (``piece``, ``document``, ``line``), number (of the
    piece, or of the oversized line, 0 for the document), start_char and end_char
    without the overlap, boundary, piece_text and text_hash (the first 16 hex digits of the
    text's SHA-256).  NULL and empty texts give no rows.  The text itself says its length; any
    recorded length or count is ignored.  Oversized nodes are those that the packing had to open.
    """
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, kind string, number int, start_char long, end_char long, boundary string, piece_text string, text_hash string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                digest = hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:16] if with_text else None
                tree = Tree(t, limit, overlap)
                packed = tree.pieces()
                rows += [(k, "line" if i else "document", i, None, None, None, None, digest) for i in tree.oversized()]
                rows += [(k, "piece", i, p.start, p.end, p.boundary, t[max(0, p.start - overlap) : p.end] if with_text else None, digest) for i, p in enumerate(packed, 1)]
            out = pd.DataFrame(rows, columns=[key, "kind", "number", "start_char", "end_char", "boundary", "piece_text", "text_hash"])
            yield out.astype({"start_char": "Int64", "end_char": "Int64"})

    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text).mapInPandas(run, schema)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "notebook_sources").select("source_id", "source_text").where(F.col("source_id").isNotNull())


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized texts (line 0) and the oversized lines in them."""
    rows = split_rows(_sources(spark, sf_dir), "source_id", "source_text", with_text=False)
    return rows.where("kind <> 'piece'").select("source_id", F.col("number").alias("line_no")).distinct()


def once(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row of each key and text; deliveries of the same row are combined before they are shuffled."""
    h: Column = F.xxhash64(text)
    return df.groupBy(key, h.alias("_h"), F.length(text).alias("_n")).agg(F.first(text).alias(text)).drop("_h", "_n")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered pieces of every text, with their overlap."""
    rows = split_rows(once(_sources(spark, sf_dir), "source_id", "source_text"), "source_id", "source_text")
    return rows.where("kind = 'piece'").select("source_id", F.col("number").alias("piece_no"), "start_char", "end_char", "boundary", "piece_text", "text_hash")


def rejoined(pieces: DataFrame, key: str, overlap: int = 200) -> DataFrame:
    """The texts again from their pieces (key, piece_no, start_char, piece_text, text_hash): the key, text, pieces, longest, and whether all overlaps agree.

    Each piece gives what follows its overlap.  Texts that share a key are told apart by text_hash.
    """
    parts = pieces.groupBy(key, "text_hash").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start_char", "piece_text"))).alias("p"))
    begin = F.least(F.lit(overlap).cast("long"), F.col("p")[0]["start_char"])  # keeps the type long
    own = F.transform("p", lambda x: F.substring(x["piece_text"], (F.least(F.lit(overlap).cast("long"), x["start_char"]) + 1).cast("int"), F.length(x["piece_text"])))
    tails = F.zip_with(
        F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))),
        F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(1))),
        lambda x, before: x.isNull() | before.isNull() | before["piece_text"].endswith(F.substring(x["piece_text"], 1, overlap)) | (F.length(before["piece_text"]) < overlap),
    )
    longest = F.array_max(F.transform("p", lambda x: F.length(x["piece_text"])))
    return parts.select(key, F.array_join(own, "").alias("text"), F.size("p").alias("pieces"), longest.alias("longest"), (F.forall(tails, lambda x: x) & (begin == 0)).alias("overlaps_agree"))


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text put together again from its pieces: its length and hash, and whether its pieces keep the limit and their overlaps."""
    r = rejoined(p3_pieces(spark, sf_dir), "source_id")
    return r.select("source_id", F.length("text").cast("long").alias("characters"), F.substring(F.sha2(F.encode("text", "utf-8"), 256), 1, 16).alias("text_hash"), (F.col("longest") <= 14_000).alias("within_limit"), "overlaps_agree")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_rejoined": p3_rejoined}
ORACLE = {
    "p3_found": """
WITH t AS (SELECT DISTINCT source_id, source_text FROM notebook_sources WHERE length(source_text) > 14000),
lines AS (SELECT source_id, unnest(string_split(source_text, chr(10))) AS line, generate_subscripts(string_split(source_text, chr(10)), 1) AS n FROM t)
SELECT DISTINCT source_id, CAST(0 AS INTEGER) AS line_no FROM t
UNION SELECT source_id, CAST(n AS INTEGER) FROM lines WHERE length(CASE WHEN right(line, 1) = chr(13) THEN left(line, -1) ELSE line END) > 14000
""",
    "p3_rejoined": "SELECT source_id, length(source_text) AS characters, left(sha256(source_text), 16) AS text_hash, true AS within_limit, true AS overlaps_agree FROM (SELECT DISTINCT source_id, source_text FROM notebook_sources WHERE source_text <> '' AND source_id IS NOT NULL)",
}
