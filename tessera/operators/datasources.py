"""Deep scan results: nested workspaces and the artifacts that use certain data sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scanned workspace as it is delivered: its artifacts with the instances they use.
WORKSPACE = (
    "id string, name string, datasets array<struct<id:string,name:string,datasourceUsages:array<struct<datasourceInstanceId:string>>>>, "
    "dataflows array<struct<objectId:string,name:string,datasourceUsages:array<struct<datasourceInstanceId:string>>>>"
)


def artifacts(scans: DataFrame, body: str) -> DataFrame:
    """One row per artifact of each scanned workspace: workspace_id, workspace_name, artifact_type, artifact_id, artifact_name, instances (lower case)."""
    w = scans.select(F.from_json(body, WORKSPACE).alias("w")).where("w IS NOT NULL")

    def of(field: str, kind: str, key: str) -> Column:
        return F.transform(
            F.coalesce(F.col(f"w.{field}"), F.array()),
            lambda a: F.struct(F.lit(kind).alias("t"), a[key].alias("i"), a["name"].alias("n"), F.transform(a["datasourceUsages"], lambda u: F.lower(u["datasourceInstanceId"])).alias("u")),
        )

    each = w.select("w.id", "w.name", F.explode(F.concat(of("datasets", "Dataset", "id"), of("dataflows", "Dataflow", "objectId"))).alias("a"))
    return each.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace_name"), F.col("a.t").alias("artifact_type"), F.col("a.i").alias("artifact_id"), F.col("a.n").alias("artifact_name"), F.col("a.u").alias("instances"))


def using(found: DataFrame, targets: DataFrame, target_id: str) -> DataFrame:
    """Artifacts that use one of the target instances; the instances are joined, so their number doesn't matter."""
    one = found.withColumn("instance", F.explode("instances"))
    wanted = targets.select(F.lower(target_id).alias("instance")).distinct()
    keys = ["workspace_id", "workspace_name", "artifact_type", "artifact_id", "artifact_name"]
    return one.join(wanted, "instance", "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("instance")).alias("matched"))


def placeholders(workspaces: DataFrame, found: DataFrame, note: str = "(none)") -> DataFrame:
    """Every workspace with its matches, or a single placeholder row."""
    joined = workspaces.select("workspace_id").join(found, "workspace_id", "left")
    return joined.withColumn("artifact_name", F.coalesce("artifact_name", F.lit(note)))
