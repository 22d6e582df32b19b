"""Names derived from paths, model ids and tool names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_PROJECT = "(unknown project)"


def sanitize_path(path: Column) -> Column:
    """Everything but ASCII letters and digits becomes a dash."""
    return F.regexp_replace(path, "[^a-zA-Z0-9]", "-")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p != "")


def base_name(path: Column) -> Column:
    """Last part of a path written with either slash."""
    return F.coalesce(F.try_element_at(path_parts(path), F.lit(-1)), path)


def short_model(model: Column) -> Column:
    """Without the vendor prefix and the date suffix."""
    return F.regexp_replace(F.regexp_replace(model, "^claude-", ""), r"-\d{8}$", "")


def model_slug(display: Column) -> Column:
    """Model id of a display name, e.g. "Gemini 3.1 Pro (High)"."""
    bare = F.trim(F.regexp_replace(display, r"\s*\(.*\)\s*$", ""))
    slug = F.regexp_replace(F.lower(bare), r"\s+", "-")
    return F.when(slug.startswith("claude"), F.translate(slug, ".", "-")).otherwise(slug)


def is_mcp_tool(tool: Column) -> Column:
    """P33."""
    return tool.startswith("mcp__")


def server_of_tool(tool: Column) -> Column:
    """P25: server part of an MCP tool name, NULL for other tools."""
    return F.nullif(F.regexp_extract(tool, "^mcp__(.+)__[^_]", 1), F.lit(""))


def display_server(name: Column, configured: Column) -> Column:
    """Plugin servers that no config names read as "plugin:server"."""
    bare = F.regexp_replace(name, "^plugin_", "")
    cut = F.instr(bare, "_")
    pretty = F.when(cut > 0, F.concat(F.substr(bare, F.lit(1), cut - 1), F.lit(":"), F.substr(bare, cut + 1))).otherwise(bare)
    return F.when(~configured & name.startswith("plugin_"), pretty).otherwise(name)


def printable_chars(latin1: Column) -> Column:
    """Characters inside printable ASCII runs of at least twenty."""
    runs = F.regexp_extract_all(latin1, F.lit("[\\x20-\\x7e]{20,}"), F.lit(0))
    return F.aggregate(runs, F.lit(0).cast("bigint"), lambda acc, run: acc + F.length(run))


def estimated_tokens(chars: Column) -> Column:
    """A quarter of the characters, rounded."""
    return F.floor(chars / 4 + 0.5)
