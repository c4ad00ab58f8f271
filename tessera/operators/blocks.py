"""Blocks of a document: cells, outputs and raw text of the known containers."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from typing import NamedTuple

# The marks of a source export.
HEADER = "# Fabric notebook source"
CELL, MARKDOWN, METADATA, META = "# CELL ****", "# MARKDOWN ****", "# METADATA ****", "# META"


class Block(NamedTuple):
    text: str
    cell_index: int
    source_kind: str
    part_path: str


def _joined(value) -> str:
    return "".join(map(str, value)) if isinstance(value, list) else str(value)


def _cells(cells, part: str, extras: bool, mime: bool) -> Iterator[Block]:
    for i, cell in enumerate(cells if isinstance(cells, list) else []):
        if not isinstance(cell, dict):
            continue
        kind = cell.get("cell_type")
        if kind == "code" or kind == "markdown" and extras:
            yield Block(_joined(cell.get("source", [])), i, kind, part)
        for out in (cell.get("outputs") or []) if extras else []:
            if not isinstance(out, dict):
                continue
            if out.get("text"):
                yield Block(_joined(out["text"]), i, "output", part)
            if mime:
                yield from (Block(_joined(v), i, "output", part) for k, v in (out.get("data") or {}).items() if "text" in k.lower())


def is_source_export(text: str) -> bool:
    head = text.lstrip()
    return head.startswith(HEADER) or METADATA in text and META + " {" in text


def exported_cells(text: str) -> tuple[dict | None, list[tuple[str, int, str]]]:
    """Metadata of the document, and (text, index, kind) of the cells of a source export."""
    sections: list[tuple[str, list[str]]] = [("head", [])]
    for line in text.splitlines():
        mark = next((k for k, m in (("meta", METADATA), ("code", CELL), ("markdown", MARKDOWN)) if line.startswith(m)), None)
        if mark:
            sections.append((mark, []))
        else:
            sections[-1][1].append(line)
    meta, cells = None, []
    for kind, lines in sections:
        if kind == "meta" and meta is None and not cells:
            told = "\n".join(x[len(META) + 1 :] for x in lines if x.startswith(META))
            try:
                found = json.loads(told) if told.strip() else None
                meta = found if isinstance(found, dict) else None
            except ValueError:
                meta = None
        elif kind in ("code", "markdown"):
            body = "\n".join(lines).strip("\n")
            if kind == "markdown":
                body = "\n".join("" if x == "#" else x.removeprefix("# ") for x in body.split("\n"))
            cells.append((body, len(cells), kind))
    return meta, cells


def _decoded(payload: str) -> str | None:
    try:
        return base64.b64decode(payload).decode("utf-8", "ignore")
    except ValueError:
        return None


def _part(i: int, path: str, text: str, extras: bool) -> Iterator[Block]:
    if path.endswith(".ipynb"):
        try:
            yield from _cells((json.loads(text) or {}).get("cells"), path, extras, False)
        except (ValueError, AttributeError):
            yield Block(text, i, "raw", path)
    elif path.endswith(".py"):
        cells = exported_cells(text)[1] if is_source_export(text) else []
        if cells:
            yield from (Block(b, k, kind, path) for b, k, kind in cells if extras or kind == "code")
        else:
            yield Block(text, i, "code", path)
    elif extras:
        yield Block(text, i, "markdown" if path.endswith(".md") else "raw", path)


def blocks(content: bytes | str, path: str, extras: bool = True) -> list[Block]:
    """The blocks of a document; ``extras`` adds markdown, outputs and raw parts.

    Source exports, notebooks, item envelopes with base64 parts and property envelopes are
    opened; a broken or unknown one is a single raw block.
    """
    text = content.decode("utf-8", "ignore") if isinstance(content, (bytes, bytearray)) else str(content or "")
    low = (path or "").lower()
    if low.endswith(".py"):
        return [b._replace(part_path="") for b in _part(0, low, text, extras)]
    if low.endswith(".md"):
        return [Block(text, 0, "markdown", "")]
    if low.endswith((".ipynb", ".json")) or text.lstrip().startswith("{"):
        try:
            data = json.loads(text)
        except ValueError:
            data = None
        if isinstance(data, dict):
            if isinstance(data.get("cells"), list):
                return list(_cells(data["cells"], "", extras, True))
            parts = (data.get("definition") or {}).get("parts") or []
            opened = [b for i, p in enumerate(parts) if p.get("payload") and (t := _decoded(p["payload"])) is not None for b in _part(i, p.get("path") or "", t, extras)]
            if opened:
                return opened
            cells = (data.get("properties") or {}).get("cells") or []
            if cells:
                return [b for b in _cells(cells, "", extras, False) if b.source_kind != "output"]
    return [Block(text, 0, "raw", "")]


def attached_lakehouse(content: bytes | str, path: str) -> tuple[str | None, str | None, str | None]:
    """Id, name and workspace id of the lakehouse that a document's metadata attaches; the first known id where no default is named.

    The workspace's name is in no document: ``with_names`` looks it up by the id.
    """
    text = content.decode("utf-8", "ignore") if isinstance(content, (bytes, bytearray)) else str(content or "")
    candidates = []
    if is_source_export(text):
        candidates.append(exported_cells(text)[0])
    elif text.lstrip().startswith("{"):
        try:
            data = json.loads(text)
        except ValueError:
            data = {}
        data = _object(data)
        candidates += [data.get("metadata"), _object(data.get("properties")).get("metadata")]
        for p in _object(data.get("definition")).get("parts") or []:
            t = _decoded(p.get("payload") or "") or ""
            if is_source_export(t):
                candidates.append(exported_cells(t)[0])
            elif t.lstrip().startswith("{"):
                try:
                    candidates.append(json.loads(t).get("metadata"))
                except ValueError:
                    continue
    for meta in candidates:
        at = _object(_object(_object(meta).get("dependencies")).get("lakehouse"))
        known = at.get("known_lakehouses")
        first = _object(known[0]) if isinstance(known, list) and known else {}
        id_ = next((v for v in (at.get("default_lakehouse"), at.get("default_lakehouse_id"), first.get("id"), first.get("lakehouse_id")) if v), None)
        found = (id_, at.get("default_lakehouse_name") or None, at.get("default_lakehouse_workspace_id") or None)
        if any(found):
            return found
    return None, None, None


def _object(value) -> dict:
    return value if isinstance(value, dict) else {}
