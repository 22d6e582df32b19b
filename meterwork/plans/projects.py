"""Projects: sessions grouped by working directory or log folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNKNOWN_PROJECT, base_name, path_parts
from ..operators.ranking import with_rank
from ..operators.servers import merge_servers
from ..operators.usage import SESSION, Facts, clamp
from .reports import DAILY, totals

PROJECT = ["agent_id", "project_id"]


def cwd_sessions(facts: Facts) -> Facts:
    """Sessions with usage, with the project their working directory names; cubes gain ``project_id``."""
    cwd = F.coalesce("cwd", F.lit(UNKNOWN_PROJECT))
    used = facts.usage.select(*SESSION).distinct()
    sessions = facts.sessions.join(used, SESSION, "left_semi").select(
        "*", F.concat_ws(":", "agent_id", cwd).alias("project_id")
    )
    return _attach(facts, sessions)


def folder_sessions(facts: Facts, root: str) -> Facts:
    """project = first path part below ``root``; sessions without usage stay."""
    rel = F.substr("file", F.instr("file", root.rstrip("/") + "/") + len(root.rstrip("/")) + 1)
    sessions = facts.sessions.select("*", F.substring_index(rel, "/", 1).alias("project_id"))
    return _attach(facts, sessions)


def _attach(facts: Facts, sessions: DataFrame) -> Facts:
    """Project ids reach the cubes through a join at cube grain, after the log rows were summed."""
    ids = sessions.select(*SESSION, "project_id")
    return Facts(facts.usage.join(ids, SESSION), facts.tools.join(ids, SESSION), sessions)


def _label(path: Column) -> Column:
    return F.when(path == UNKNOWN_PROJECT, path).otherwise(base_name(path))


def cwd_project_dim(sessions: DataFrame) -> DataFrame:
    """(agent_id, project_id, name, label, real_path)."""
    name = F.coalesce("cwd", F.lit(UNKNOWN_PROJECT))
    return sessions.select(
        *PROJECT, name.alias("name"), _label(name).alias("label"), F.nullif(name, F.lit(UNKNOWN_PROJECT)).alias("real_path")
    ).distinct()


def folder_project_dim(sessions: DataFrame, real_paths: DataFrame) -> DataFrame:
    """Folder to real path by the global configuration, else the first working directory in file order."""
    seen = sessions.groupBy(*PROJECT).agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("file"))).alias("first_cwd")
    )
    mapped = seen.join(real_paths.withColumnRenamed("sanitized", "project_id"), "project_id", "left")
    real = F.coalesce("real_path", "first_cwd")
    return mapped.select(
        *PROJECT,
        F.coalesce(real, F.col("project_id")).alias("name"),
        F.coalesce(base_name(real), F.col("project_id")).alias("label"),
        real.alias("real_path"),
    )


def project_servers(dim: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured servers of each project, joined on its real path."""
    return dim.select(*PROJECT, F.col("real_path").alias("project_path")).join(configured, "project_path").select(
        *PROJECT, "name", "source"
    )


def project_list(facts: Facts, dim: DataFrame, bounds: tuple[str, str] | None = None, live: DataFrame | None = None) -> DataFrame:
    """Totals per project; a range rebuilds them and drops projects without activity in it."""
    cut = clamp(facts, bounds)
    return dim.join(totals(cut.usage, cut.sessions, PROJECT, live), PROJECT)


def merged_daily(project_daily: DataFrame, scope: list[str]) -> DataFrame:
    """Daily rows of many projects summed by date."""
    return project_daily.groupBy(*scope, "day").agg(*[F.sum(c).alias(c) for c in DAILY])


def merged_servers(audits: DataFrame, scope: list[str], project_cost: DataFrame) -> DataFrame:
    """Servers merged by name; projects come costliest first, so that one's source is kept."""
    ranked = audits.join(project_cost.select(*PROJECT, (-F.col("total_cost_usd")).alias("_order")), PROJECT, "left")
    return merge_servers(ranked, scope, ["_order", "project_id"])


def display_labels(projects: DataFrame) -> DataFrame:
    """Labels used more than once get the parent folder."""
    twice = F.count("*").over(Window.partitionBy("label")) > 1
    parent = F.try_element_at(path_parts(F.col("name")), F.lit(-2))
    shown = F.when(twice & parent.isNotNull(), F.concat("label", F.lit(" ("), parent, F.lit(")"))).otherwise(F.col("label"))
    return projects.withColumn("display_label", shown)


def matching(projects: DataFrame, query: str) -> DataFrame:
    """Label or name contains the text, ignoring case."""
    q = query.lower()
    return projects.filter(F.lower("label").contains(q) | F.lower("name").contains(q)) if q else projects


def ordered(projects: DataFrame, mode: str = "cost") -> DataFrame:
    """By cost, by most recent activity or by name, ties by id; ``rank`` holds the place."""
    keys = {
        "cost": F.desc("total_cost_usd"),
        "recent": F.desc(F.coalesce("span_end", F.lit(""))),
        "name": F.asc("label"),
    }
    return with_rank(projects, [keys[mode], F.asc("project_id")])
