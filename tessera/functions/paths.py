"""Paths: attribution to a workspace and date, and target paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import safe_segment

# Fixed value: a workspace id followed by a folder that begins with a date.
DATED = r"/([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})/(\d{8}[^/]*)/"


def attribute(path: Column, base: str | None = None, default_id: str | None = None, default_name: str | None = None) -> tuple[Column, Column, Column]:
    """Workspace id, name and dated partition of a path.

    Below ``base`` its first two folders count; else the first id and date anywhere; else the
    defaults with a NULL date.  An id found in the path is its own name.
    """
    anchored = re.escape(base.rstrip("/")) + "/([^/]+)/([^/]+)/" if base else None
    found = [F.nullif(F.regexp_extract(path, p, i), F.lit("")) for i in (1, 2) for p in (anchored, DATED) if p]
    half = len(found) // 2
    id_, date = F.coalesce(*found[:half]), F.coalesce(*found[half:])
    return F.coalesce(id_, F.lit(default_id or "")), F.coalesce(id_, F.lit(default_name or default_id or "")), date


# How each export mode ends its primary file.
ENDINGS = {"ipynb": ".ipynb", "py": ".py", "txt": ".txt"}
OTHER_ENDING = "__definition.txt"


def item_paths(root: Column, run: Column, workspace_id: Column, workspace_name: Column, item_type: Column, item_id: Column, name: Column, mode: Column, by_type: bool = True) -> tuple[Column, Column]:
    """Primary and JSON target of a downloaded item: root/run/workspace/type/name."""
    pick = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    folder = F.concat(root, F.lit("/"), run, F.lit("/"), safe_segment(pick(workspace_name, workspace_id, F.lit("unknown_ws"))), F.lit("__"), workspace_id)
    if by_type:
        folder = F.concat(folder, F.lit("/"), safe_segment(item_type, 40))
    file = F.concat(folder, F.lit("/"), safe_segment(pick(name, item_id)), F.lit("__"), item_id)
    ending = F.lit(OTHER_ENDING)
    for m, e in ENDINGS.items():
        ending = F.when(mode == m, e).otherwise(ending)
    return F.concat(file, ending), F.concat(file, F.lit(".item.json"))


def part_name(path: Column) -> Column:
    """A part's path as one file name: slashes as double underscores, leading dots gone, ``part`` where nothing is left."""
    flat = F.regexp_replace(F.replace(F.regexp_replace(path, "^/+|/+$", ""), F.lit("/"), F.lit("__")), r"^\.+", "")
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("part"))


def is_content_part(path: Column) -> Column:
    """Whether a part is its item's main payload."""
    low = F.lower(F.coalesce(path, F.lit("")))
    return low.contains("notebook-content") | low.contains("pipeline-content") | low.contains("mashup") | low.endswith(".ipynb")
