"""Item definitions: parts, files, hashes and manifest rows; classification and plans of a split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import is_content_part, item_paths
from tessera.functions.text import safe_segment

PARTS = "definition struct<parts:array<struct<path:string,payload:string,payloadType:string>>>"
# Languages of a notebook's source part.
LANGUAGES = ("py", "scala", "sql", "r")

#: Of one item: its description and the parts of its definition to the columns that make its files: [(name, bytes)].
Handler = Callable[[Column, Column], Column]
#: Item types with their own way from a definition to files; every other type saves its parts as they are.
HANDLERS: dict[str, Handler] = {}


def handler(item_type: str) -> Callable[[Handler], Handler]:
    """Registers the function of an item type; a type has at most one."""

    def register(f: Handler) -> Handler:
        if item_type.lower() in HANDLERS:
            raise ValueError(f"{item_type} has a handler already")
        HANDLERS[item_type.lower()] = f
        return f

    return register


def decoded(payload: Column) -> Column:
    """The bytes of a base64 payload, NULL for a bad one."""
    return F.try_to_binary(payload, F.lit("base64"))


def parts(df: DataFrame, body: str) -> DataFrame:
    """One row per part of each definition: part_path (outer slashes gone), part_index, content; parts without path or content are left out."""
    opened = df.withColumn("__body", F.from_json(body, PARTS)).select(*df.columns, F.posexplode("__body.definition.parts").alias("part_index", "__part"))
    path, content = F.regexp_replace("__part.path", "^/+|/+$", ""), decoded(F.col("__part.payload"))
    return opened.select(*df.columns, "part_index", path.alias("part_path"), content.alias("content")).where((F.col("part_path") != "") & (F.length("content") > 0))


def _base(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def source_parts(paths: Column) -> Column:
    """All parts that are a notebook's source, by their name and language."""
    return F.filter(paths, lambda p: _base(p).rlike(rf"^notebook-content\.({'|'.join(LANGUAGES)})$"))


def source_part(paths: Column) -> Column:
    """The first part that is a notebook's source; NULL without one."""
    return F.try_element_at(source_parts(paths), F.lit(1))


def part_files(parts_: Column) -> Column:
    """Parts (path, payload) as files: outer slashes gone, those without a path or content left out."""
    opened = F.transform(parts_, lambda p: F.struct(F.regexp_replace(p["path"], "^/+|/+$", "").alias("name"), decoded(p["payload"]).alias("bytes")))
    return F.filter(opened, lambda f: (F.coalesce(f["name"], F.lit("")) != "") & (F.length(f["bytes"]) > 0))


# Types whose files are the parts of their definition.
PLAIN_TYPES = "Dataflow Environment Eventstream KQLDatabase DataPipeline Report SemanticModel SparkJobDefinition".split()
for _type in PLAIN_TYPES:
    handler(_type)(lambda item, parts_: part_files(parts_))


@handler("Notebook")
def _notebook(item: Column, parts_: Column) -> Column:
    """The notebook's source alone, under the name of its language."""
    return F.slice(F.filter(part_files(parts_), lambda f: _base(f["name"]).rlike(rf"^notebook-content\.({'|'.join(LANGUAGES)})$")), 1, 1)


@handler("Lakehouse")
def _lakehouse(item: Column, parts_: Column) -> Column:
    """A lakehouse has no definition worth keeping: its description is its file."""
    return F.array(F.struct(F.lit("lakehouse_metadata.json").alias("name"), F.to_json(item).cast("binary").alias("bytes")))


def item_files(items: DataFrame, body: str, item_type: str = "item_type") -> DataFrame:
    """One row per file of each item (file_name, content), made by the handler of its type, whatever the type's case.

    Items without a definition, and parts without a path or content, give none; a lakehouse's file is its description.
    """
    described = F.struct(*[F.col(c) for c in items.columns if c != body])
    parts_ = F.from_json(body, PARTS)["definition"]["parts"]
    kind, files = F.lower(F.trim(F.coalesce(item_type, F.lit("")))), part_files(parts_)
    for name, make in HANDLERS.items():
        files = F.when(kind == name, make(described, parts_)).otherwise(files)
    opened = items.withColumn("__file", F.explode(files)).drop(body)
    return opened.select("*", F.col("__file.name").alias("file_name"), F.col("__file.bytes").alias("content")).drop("__file")


def manifest(items: DataFrame, body: str, root: Column, run: Column, at: Column, existing: DataFrame | None = None) -> DataFrame:
    """The 21 manifest columns of downloaded items (workspace_id, workspace_name, item_type, item_id, display_name, export_format and the definition).

    ``export_format`` ipynb, py and txt save one part (the notebook, its source under its language's ending, or as text), parts saves all.
    http_status, attempts, token_refreshes and fetch_error are the items' own where they have them.  No definition, no or several
    source parts, and an empty one are errors; parts without a main one are ok with a warning.  ``existing`` (path) lists targets
    that are there already: an item of which nothing new is saved is skipped_exists.  payload_bytes and sha256 are of the main part.
    """
    own = lambda c, default: F.col(c) if c in items.columns else default
    every = F.coalesce(F.from_json(body, PARTS)["definition"]["parts"], F.array().cast("array<struct<path:string,payload:string,payloadType:string>>"))
    primary, record = item_paths(root, run, F.col("workspace_id"), F.col("workspace_name"), F.col("item_type"), F.col("item_id"), F.col("display_name"), F.col("export_format"))
    stem = F.regexp_replace(record, r"\.item\.json$", "")
    m = items.withColumns({"__parts": every, "__mode": F.lower(F.coalesce("export_format", F.lit("parts"))), "__record": record, "__stem": stem, "__primary": primary})
    single, mode = F.col("__mode").isin("ipynb", "py", "txt"), F.col("__mode")
    books = F.filter("__parts", lambda p: F.lower(p["path"]).endswith(".ipynb") & (F.coalesce(p["payload"], F.lit("")) != ""))
    sources = F.filter("__parts", lambda p: _base(F.regexp_replace(p["path"], "^/+|/+$", "")).rlike(rf"^notebook-content\.({'|'.join(LANGUAGES)})$"))
    chosen = F.try_element_at(F.when(mode == "ipynb", books).otherwise(sources), F.lit(1))
    ending = F.when(mode == "py", F.concat(F.lit("."), F.substring_index(F.lower(F.col("__one")["path"]), ".", -1))).when(mode == "txt", ".txt").otherwise(".ipynb")
    named = F.transform(part_files(F.col("__parts")), lambda f: F.struct(f["name"].alias("name"), f["bytes"].alias("bytes"), F.concat(F.col("__stem"), F.lit("__"), safe_segment(F.replace(f["name"], F.lit("/"), F.lit("__")), 160), F.lit(".txt")).alias("target")))
    one = F.array(F.struct(F.col("__one")["path"].alias("name"), decoded(F.col("__one")["payload"]).alias("bytes"), F.concat(F.col("__stem"), ending).alias("target")))
    m = m.withColumn("__one", F.when(single, chosen)).withColumn("__files", F.when(single & F.col("__one").isNotNull(), one).when(~single, named).otherwise(F.array().cast("array<struct<name:string,bytes:binary,target:string>>")))
    if existing is None:
        m = m.withColumn("__there", F.array().cast("array<string>"))
    else:
        wanted = m.select("item_id", "workspace_id", F.explode("__files.target").alias("path"))
        there = wanted.join(existing.select("path").distinct(), "path", "left_semi").groupBy("item_id", "workspace_id").agg(F.collect_set("path").alias("__there"))  # at most an item's parts
        keys = there.withColumnsRenamed({"item_id": "__i", "workspace_id": "__w"})
        m = m.join(keys, F.col("item_id").eqNullSafe(F.col("__i")) & F.col("workspace_id").eqNullSafe(F.col("__w")), "left").drop("__i", "__w").withColumn("__there", F.coalesce("__there", F.array().cast("array<string>")))
    content, n = F.exists("__parts", lambda p: is_content_part(p["path"])), F.size("__parts")
    saved = F.filter("__files", lambda f: ~F.array_contains(F.col("__there"), f["target"]) & f["bytes"].isNotNull())
    main = F.when(single, F.try_element_at(F.col("__files"), F.lit(1))).otherwise(F.try_element_at(F.filter(saved, lambda f: is_content_part(f["name"])), F.lit(-1)))
    failed = (
        F.when(own("fetch_error", F.lit(None).cast("string")).isNotNull(), own("fetch_error", F.lit(None).cast("string")))
        .when(F.col(body).isNull(), "no body")
        .when(n == 0, "empty definition")
        .when((mode == "ipynb") & (F.size(books) == 0), "no notebook part")
        .when(single & (mode != "ipynb") & (F.size(sources) == 0), "no source part")
        .when(single & (mode != "ipynb") & (F.size(sources) > 1), "several source parts")
        .when(single & (F.length(F.col("__one")["payload"]) == 0), "empty source part")
    )
    m = m.withColumns({"__error": failed, "__saved": saved, "__main": main})
    fine = F.col("__error").isNull()
    return m.select(
        "workspace_id", "workspace_name", "item_type", "item_id", "display_name",
        F.coalesce(F.when(fine, F.col("__main")["target"]), "__primary").alias("rel_path"), F.coalesce(F.when(fine, F.col("__main")["target"]), "__primary").alias("primary_target"), F.col("__record").alias("item_json_target"), "export_format",
        n.alias("part_count"), F.when(fine, F.size("__saved")).otherwise(0).alias("parts_saved"), F.when(n > 0, content).alias("has_content_part"),
        F.when(fine, F.coalesce(F.length(F.col("__main")["bytes"]), F.lit(0))).otherwise(0).cast("long").alias("payload_bytes"), F.when(fine, F.sha2(F.col("__main")["bytes"], 256)).alias("sha256"),
        own("attempts", F.lit(1)).alias("attempts"), own("token_refreshes", F.lit(0)).alias("token_refreshes"), own("http_status", F.when(F.col(body).isNotNull(), 200)).alias("http_status"),
        F.when(~fine, "error").when(F.size("__saved") > 0, "ok").otherwise("skipped_exists").alias("status"), F.coalesce("__error", F.when(~content, "no content part")).alias("error"), run.alias("run_label"), at.alias("downloaded_at"),
    )


def outstanding(items: DataFrame, listing: DataFrame, target: str) -> DataFrame:
    """Items whose target isn't in a listing of existing paths: what is left of an interrupted run."""
    return items.join(listing.select(F.col("path").alias(target)), target, "left_anti")


def resolve_types(known: DataFrame, wanted: list[str] | None, excluded: list[str] = ()) -> DataFrame:
    """Item types wanted (all, where None) without the excluded ones, whatever their case and outer blanks."""
    same = F.lower(F.trim("item_type"))
    rows = known.select("item_type").distinct()
    if wanted is not None:
        rows = rows.where(same.isin([w.strip().lower() for w in wanted]))
    return rows.where(~same.isin([x.strip().lower() for x in excluded])) if excluded else rows


def classified(items: DataFrame, types_to_a: list[str]) -> DataFrame:
    """Items with an id, and the group A or B by their type."""
    a = F.lower(F.trim(F.coalesce("item_type", F.lit("")))).isin([t.strip().lower() for t in types_to_a])
    return items.where(F.coalesce("item_id", F.lit("")) != "").withColumn("target_workspace", F.when(a, "A").otherwise("B"))


def split_plan(items: DataFrame, a_id: str, b_id: str, source_id: str) -> DataFrame:
    """Where each classified item goes, and whether it is there already."""
    target = F.when(F.col("target_workspace") == "A", a_id).otherwise(b_id)
    here = F.coalesce(F.nullif("workspace_id", F.lit("")), F.lit(source_id))
    return items.select(
        "item_id", F.coalesce("item_type", F.lit("")).alias("item_type"), F.coalesce(F.nullif("display_name", F.lit("")), "item_id").alias("name"),
        F.lit(source_id).alias("source_workspace_id"), "target_workspace", target.alias("target_workspace_id"), F.when(target == here, "leave").otherwise("move").alias("action"),
    )
