"""Tool servers: configuration scan, calls per server, observed-only servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as c
from ..functions.text import server_of_tool
from .dedup import keep_first

# Fixed value: the source shown for servers that no configuration names.
OBSERVED_SOURCE = "observed in transcripts (plugin or external config)"


def _names(text: Column, path: str) -> Column:
    """Keys of an object field in document order, [] if it is not an object."""
    parsed = F.from_json(text, "map<string,string>")
    inner = F.try_element_at(parsed, F.lit(path))
    return F.coalesce(F.map_keys(F.from_json(inner, "map<string,string>")), F.lit([]).cast("array<string>"))


def configured_servers(project_files: DataFrame, global_files: DataFrame, projects: DataFrame) -> DataFrame:
    """(home, project_path, name, source); project file beats global file beats the global per-project entry.

    project_files(project_path, file, value), global_files(file, value) and
    projects(project_path), each with ``home`` unless all files are of one home.
    Names of a global file hold for every project of its home.
    """
    one_home = "home" not in global_files.columns
    if one_home:
        project_files, global_files, projects = (df.withColumn("home", F.lit("")) for df in (project_files, global_files, projects))
    place = ["home", "project_path"]
    projects = projects.select(*place).distinct()
    empty = F.lit([]).cast("array<string>")
    top = global_files.select("home", "file", "value", F.from_json("value", "map<string,string>").alias("doc"))
    own = project_files.select(*place, F.posexplode(_names(F.col("value"), "mcpServers")).alias("pos", "name"), "file")
    ranked_own = own.select(*place, "name", F.col("file").alias("source"), F.lit(0).alias("rank"), "pos")
    shared = top.select("home", "file", F.posexplode(_names(F.col("value"), "mcpServers")).alias("pos", "name"))
    ranked_shared = projects.join(shared, "home").select(*place, "name", F.col("file").alias("source"), F.lit(1).alias("rank"), "pos")
    entries = top.select(
        "home", "file", F.explode(F.from_json(F.try_element_at("doc", F.lit("projects")), "map<string,string>")).alias("project_path", "entry")
    )
    listed = entries.select(
        *place, "file", F.posexplode(F.coalesce(_names(F.col("entry"), "mcpServers"), empty)).alias("pos", "name")
    ).join(projects, place, "left_semi")
    ranked_entry = listed.select(
        *place, "name", F.concat("file", F.lit(" (project entry)")).alias("source"), F.lit(2).alias("rank"), "pos"
    )
    every = ranked_own.unionByName(ranked_shared).unionByName(ranked_entry)
    kept = keep_first(every, [*place, "name"], ["rank", "pos"]).select(*place, "name", "source", "rank", "pos")
    return kept.drop("home") if one_home else kept


def _cut_points(name: Column, pad: str) -> Column:
    """Every proper start of ``name`` that is followed by a double underscore."""
    padded = F.concat(name, F.lit(pad))
    at = F.filter(F.sequence(F.lit(1), F.length(padded)), lambda i: F.substr(padded, i, F.lit(2)) == "__")
    return F.transform(at, lambda i: F.substr(padded, F.lit(1), i - 1))


def tool_servers(tools: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, name, calls, cost_usd) for every server name a tool name can belong to.

    A tool may match several nested names. Names are cut out of the tool name,
    so matching them against configured servers is an equi-join.
    """
    mcp = tools.filter(F.col("tool_name").startswith("mcp__"))
    rest = F.substr(F.col("tool_name"), F.lit(6))
    return (
        mcp.select(*scope, "calls", "cost_usd", F.explode(_cut_points(rest, "")).alias("name"))
        .groupBy(*scope, "name")
        .agg(F.sum("calls").alias("calls"), F.sum("cost_usd").alias("cost_usd"))
    )


def observed_only(tools: DataFrame, servers: DataFrame, scope: list[str]) -> DataFrame:
    """Servers seen in tool names that neither equal a configured name nor extend one by a double underscore."""
    seen = tools.select(*scope, server_of_tool(F.col("tool_name")).alias("name")).filter("name IS NOT NULL").distinct()
    starts = seen.select(*scope, "name", F.explode(_cut_points(F.col("name"), "__")).alias("start"))
    known = servers.select(*scope, F.col("name").alias("start")).distinct()
    covered = starts.join(known, [*scope, "start"], "left_semi").select(*scope, "name").distinct()
    return seen.join(covered, [*scope, "name"], "left_anti")


def server_audit(tools: DataFrame, servers: DataFrame, scope: list[str]) -> DataFrame:
    """Calls and estimated cost per configured server plus the observed-only ones.

    tools(scope, tool_name, calls, cost_usd), servers(scope, name, source).
    """
    extra = observed_only(tools, servers, scope)
    names = servers.select(*scope, "name", "source", F.lit(True).alias("configured")).unionByName(
        extra.select(*scope, "name", F.lit(OBSERVED_SOURCE).alias("source"), F.lit(False).alias("configured"))
    )
    calls = F.coalesce("calls", F.lit(0))
    return names.join(tool_servers(tools, scope), [*scope, "name"], "left").select(
        *scope,
        "name",
        "source",
        calls.cast("bigint").alias("calls"),
        ((calls == 0) & F.col("configured")).alias("unused"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        "configured",
    )


def merge_servers(audits: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """One row per name over many projects; the first source in ``order`` is kept."""
    calls = F.sum("calls")
    return audits.groupBy(*scope, "name").agg(
        F.min_by("source", F.struct(*order)).alias("source"),
        calls.alias("calls"),
        (calls == 0).alias("unused"),
        F.sum("cost_usd").alias("cost_usd"),
        F.bool_or("configured").alias("configured"),
    )


def config_project_paths(global_files: DataFrame) -> DataFrame:
    """([home,] sanitized, real_path) for every project named in a global configuration; of paths that read alike the last one listed."""
    from ..functions.text import sanitize_path

    doc = F.from_json("value", "map<string,string>")
    home = ["home"] if "home" in global_files.columns else []
    keys = global_files.select(
        *home, F.posexplode(F.map_keys(F.from_json(F.try_element_at(doc, F.lit("projects")), "map<string,string>"))).alias("pos", "real_path")
    )
    return keys.groupBy(*home, sanitize_path(F.col("real_path")).alias("sanitized")).agg(
        F.max_by("real_path", F.struct("pos", "real_path")).alias("real_path")
    )
