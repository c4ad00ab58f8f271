"""Chunks of a document's code cells, of limited length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.blocks import blocks

# Fixed value: what stands between two cells of a chunk.
BOUNDARY = "\n\n# --- cell boundary ---\n\n"


def cut_lines(text: str, most: int) -> Iterator[str]:
    """Pieces of a text, cut at its last line end within reach (which is dropped), else at the limit."""
    at = 0
    while len(text) - at > most:
        end = text.rfind("\n", at + 1, at + most)
        if end < 0:
            end = at + most
        yield text[at:end]
        at = end + (text[end] == "\n")
    if at < len(text):
        yield text[at:]


def pack(cells: Iterable[str], most: int = 14_000, least: int = 0) -> list[str]:
    """Cells packed in order into chunks of at most ``most`` characters; one that is longer is cut by lines.

    A chunk shorter than ``least`` joins the one before where both fit.  Empty cells are left out.
    """
    if most <= 0:
        raise ValueError("the limit must be positive")
    out: list[str] = []
    fits_on = False  # whether the last chunk may take another cell
    for cell in filter(None, cells):
        if len(cell) > most:
            out += cut_lines(cell, most)
            fits_on = False
        elif fits_on and len(out[-1]) + len(BOUNDARY) + len(cell) <= most:
            out[-1] += BOUNDARY + cell
        else:
            out.append(cell)
            fits_on = True
    if least <= 0:
        return out
    joined: list[str] = []
    for c in out:
        if joined and len(c) < least and len(joined[-1]) + len(BOUNDARY) + len(c) <= most:
            joined[-1] += BOUNDARY + c
        else:
            joined.append(c)
    return joined


def chunk_documents(df: DataFrame, key: str, path: str, content: str, most: int = 14_000, least: int = 0) -> DataFrame:
    """One row per chunk of each document's code (of a text without cells, all of it): content_length, content_hash, chunk_index, chunk_count, chunk_text.

    Documents without any give no rows; columns other than the three named ones are left out.
    """
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, content_length long, content_hash string, chunk_index int, chunk_count int, chunk_text string"
    names = [key, "content_length", "content_hash", "chunk_index", "chunk_count", "chunk_text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, p, c in zip(pdf[key], pdf["__path"], pdf["__content"]):
                cells = [b.text for b in blocks(c, p, extras=False) if b.text]
                whole = BOUNDARY.join(cells)
                digest = hashlib.sha256(whole.encode("utf-8", "ignore")).hexdigest()[:16]
                packed = pack(cells, most, least)
                rows += [(k, len(whole), digest, i, len(packed), t) for i, t in enumerate(packed)]
            yield pd.DataFrame(rows, columns=names)

    return df.where(F.col(content).isNotNull()).select(F.col(key), F.col(path).alias("__path"), F.col(content).alias("__content")).mapInPandas(run, schema)
