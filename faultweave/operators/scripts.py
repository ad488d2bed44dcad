"""Script texts and node records for incidents, and how they are referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions.text import non_empty, or_empty, script_request, script_target
from faultweave.session import materialise


def node_for_job(inc: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``node``: the node of rank 1 whatever the job, null when there is none."""
    fields = [c for c in nodes.columns if c != "rank"]
    first = nodes.where(F.col("rank") == 1).select(F.struct(*fields).alias("node"))
    return inc.withColumn("node", first.scalar())


def script_lookup(wanted: DataFrame, scripts: DataFrame, chars: int | None = None) -> DataFrame:
    """The script of each distinct (job_name, script_name) in ``wanted``.

    The node finds a script by its target name only. The repository asks again with every
    ``.py`` of the requested name as ``.sh``, and answers "not found" by a text, so its
    record is always there. Script names are unique, as file names are. With ``chars`` only
    so many characters of a text are carried.
    """
    own, job = F.col("_own"), F.col("job_name")
    requests = wanted.select(job, or_empty(F.col("script_name")).alias("_own")).distinct()
    request = script_request(own, job)
    retry = F.when(F.endswith(request, F.lit(".py")), F.replace(request, F.lit(".py"), F.lit(".sh")))
    # Both names are looked up by one inner join, in which the few requests can be the
    # broadcast side and the script texts need not be shuffled.
    names = requests.select(
        "job_name",
        "_own",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("first"), script_target(own, job).alias("name")),
                F.struct(F.lit(False).alias("first"), retry.alias("name")),
            )
        ).alias("_try"),
    ).select("job_name", "_own", "_try.*")
    content = F.col("content") if chars is None else F.substring("content", 1, chars)
    by_name = scripts.select("name", content.alias("content"), "permissions")
    hits = (
        materialise(names.where(F.col("name").isNotNull()), "script-names")
        .join(by_name, "name")
        .groupBy("job_name", "_own")
        .agg(
            F.max(F.when(F.col("first"), F.col("content"))).alias("node_content"),
            F.max(F.when(F.col("first"), F.col("permissions"))).alias("permissions"),
            F.max(F.when(~F.col("first"), F.col("content"))).alias("_retry_content"),
        )
    )
    missing = F.concat(F.lit("No script named "), request, F.lit(" on the node."))
    found = requests.join(hits, ["job_name", "_own"], "left").select(
        "job_name",
        non_empty(own).alias("script_name"),
        request.alias("config_script"),
        F.coalesce("node_content", "_retry_content", missing).alias("config_content"),
        "node_content",
        "permissions",
        F.col("node_content").isNotNull().alias("on_node"),
    )
    return materialise(found, "scripts")


def repo_ref(
    workspace: Column, repo: Column, folder: Column, branch: Column, resolved_path: Column, script: Column
) -> Column:
    """Full path of a script in its repository, or just the path when the repository is not named."""
    inside = F.coalesce(non_empty(resolved_path), F.concat_ws("/", non_empty(folder), non_empty(script)))
    full = F.concat(workspace, F.lit("/"), repo, F.lit("/"), inside, F.lit(" @ "), branch)
    named = non_empty(workspace).isNotNull() & non_empty(repo).isNotNull()
    return F.when(named, full).otherwise(F.coalesce(non_empty(resolved_path), script))


def node_ref(on_node: Column, node: Column, script: Column) -> Column:
    """Where a script lies on its node; null when the node did not have it."""
    host, port = non_empty(node["host"]), node["port"].cast("string")
    address = F.concat(F.lit(" ("), host, F.lit(":"), port, F.lit(")"))
    folder = F.rtrim(F.coalesce(node["scripts_path"], F.lit("")), F.lit("/"))
    place = F.concat(node["name"], F.coalesce(address, F.lit("")), F.lit(" → "), folder, F.lit("/"), script)
    return F.when(on_node, place)
