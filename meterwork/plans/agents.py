"""The agent registry and cross-agent views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import SESSION_COLUMNS, TOOL_COLUMNS, USAGE_COLUMNS, Facts
from ..sources import antigravity, claude, codex, documents, json_lines, tables
from ..sources.files import LogFiles, home_files, read_listed
from .reports import totals_and_total

AGENT_DDL = (
    "position INT, agent_id STRING, name STRING, supported BOOLEAN, unsupported_reason STRING, "
    "estimated BOOLEAN, estimate_note STRING"
)


@dataclass(frozen=True)
class Agent:
    id: str
    name: str
    load: Callable[..., Facts] | None
    unsupported_reason: str | None = None
    estimate_note: str | None = None


_REGISTRY: dict[str, Agent] = {}


def register(agent: Agent) -> None:
    _REGISTRY[agent.id] = agent


def adapter(agent_id: str, name: str, estimate_note: str | None = None):
    """Decorator that adds a loader; its tables are checked against the canonical columns."""
    def wrap(load: Callable[..., Facts]) -> Callable[..., Facts]:
        def checked(*args, **kwargs) -> Facts:
            facts = load(*args, **kwargs)
            for df, columns in zip(facts, (USAGE_COLUMNS, TOOL_COLUMNS, SESSION_COLUMNS)):
                if df.columns != columns:
                    raise ValueError(f"{agent_id}: expected columns {columns}, got {df.columns}")
            return facts

        register(Agent(agent_id, name, checked, estimate_note=estimate_note))
        return checked

    return wrap


def unregister(agent_id: str) -> None:
    """Take an agent out again."""
    _REGISTRY.pop(agent_id, None)
    LOGS.pop(agent_id, None)


def detect_only(agent_id: str, name: str, reason: str) -> None:
    """An agent that is known but whose logs hold no usable counts."""
    register(Agent(agent_id, name, None, unsupported_reason=reason))


# The known agents in display order.
adapter("claude", "Claude Code")(claude.load)
adapter("codex", "OpenAI Codex")(codex.load)
adapter("opencode", "OpenCode")(documents.opencode)
adapter("gemini", "Gemini CLI")(json_lines.gemini)
adapter("qwen", "Qwen Code")(json_lines.qwen)
adapter("droid", "Droid (Factory)")(documents.droid)
adapter("codebuff", "Codebuff")(documents.codebuff)
adapter("openclaw", "OpenClaw")(json_lines.openclaw)
adapter("kimi", "Kimi CLI")(json_lines.kimi)
adapter("kilo", "Kilo")(tables.kilo)
adapter("goose", "Goose")(tables.goose)
adapter("hermes", "Hermes")(tables.hermes)
adapter("copilot", "GitHub Copilot CLI")(json_lines.copilot)
adapter("amp", "Amp")(documents.amp)
adapter("pi", "pi-agent")(json_lines.pi)
adapter(
    "antigravity",
    "Antigravity",
    estimate_note="estimate: the logs count no tokens, so the length of the conversations stands in for them",
)(antigravity.load)
detect_only("cursor", "Cursor", "usage is kept server-side only; its local files count no tokens")


# Where each agent keeps its logs below a home, in the order its loader takes them.
LOGS: dict[str, tuple[LogFiles, ...]] = {
    "claude": (LogFiles((".claude/projects",), r"\.jsonl$"),),
    "codex": (LogFiles((".codex/sessions", ".codex/archived_sessions"), r"\.jsonl$", twins=True, otherwise=".codex"),),
    "opencode": tuple(LogFiles((".local/share/opencode/storage",), p, "documents") for p in (r"^message/[^/]+/[^/]+\.json$", r"^session/.*\.json$", r"^project/[^/]+\.json$")),
    "gemini": (LogFiles((".gemini/tmp",), r"\.jsonl$"), LogFiles((".gemini/tmp",), r"\.json$", "documents")),
    "qwen": (LogFiles((".qwen",), r"^projects/.*\.jsonl$"),),
    "droid": (LogFiles((".factory/sessions",), r"\.settings\.json$", "documents"),),
    "codebuff": (LogFiles((".config/manicode", ".config/manicode-dev", ".config/manicode-staging"), r"(^|/)chat-messages\.json$", "documents"),),
    "openclaw": (LogFiles((".openclaw", ".clawdbot", ".moltbot", ".moldbot"), r"\.jsonl(\.[^/]*)?$"),),
    "kimi": (LogFiles((".kimi", ".kimi-code"), r"^sessions/(.*/)?wire\.jsonl$"),),
    "copilot": (LogFiles((".copilot/otel",), r"\.jsonl$"),),
    "amp": (LogFiles((".local/share/amp",), r"^threads/.*\.json$", "documents"),),
    "pi": (LogFiles((".pi/agent/sessions",), r"\.jsonl$"),),
    "antigravity": (LogFiles((".gemini/antigravity-cli",), r"^conversations/[^/]+\.db$", "binary"), LogFiles((".gemini/antigravity-cli",), r"^history\.jsonl$")),
}


def read_agent(spark: SparkSession, agent_id: str, homes: str | list[str], modified_after: str | None = None) -> Facts:
    """An agent's facts from the files below some homes, found by its own patterns.

    Agents that keep a table (Kilo, Goose, Hermes) are loaded from a DataFrame of it instead.
    """
    if agent_id not in LOGS:
        raise ValueError(f"{agent_id}: keeps no log files")
    inputs = [read_listed(home_files(spark, homes, logs, modified_after), logs.kind) for logs in LOGS[agent_id]]
    if agent_id == "antigravity":
        name = F.regexp_extract("path", r"([^/]*)\.db$", 1)
        inputs[0] = inputs[0].select(name.alias("conversation_id"), "content")
    return _REGISTRY[agent_id].load(*inputs)


def find(target: str) -> Agent | None:
    """By id or display name, ignoring case and outer blanks."""
    key = target.strip().lower()
    return next((a for a in _REGISTRY.values() if key in (a.id, a.name.lower())), None)


def agent_dim(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [
        (i, a.id, a.name, a.load is not None, a.unsupported_reason, a.estimate_note is not None, a.estimate_note)
        for i, a in enumerate(_REGISTRY.values())
    ]
    return spark.createDataFrame(rows, AGENT_DDL)


def all_agents(facts: list[Facts]) -> Facts:
    """One set of tables over many agents; reports then group by ``agent_id`` or not at all."""
    return Facts(*[reduce(DataFrame.unionByName, part) for part in zip(*facts)])


def agent_totals(usage: DataFrame, sessions: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """A row per agent and, when at least two have data, one over all of them."""
    return totals_and_total(usage, sessions, "agent_id", "__all_agents__", live)


def agent_status(dim: DataFrame, projects: DataFrame, detected: DataFrame) -> DataFrame:
    """Projects, sessions and cost per known agent, or why there are none.

    projects(agent_id, project_id, session_count, total_cost_usd), detected(agent_id).
    """
    found = projects.groupBy("agent_id").agg(
        F.count("*").alias("projects"), F.sum("session_count").alias("sessions"), F.sum("total_cost_usd").alias("cost_usd")
    )
    status = (
        F.when(F.col("projects") > 0, F.when(F.col("estimated"), "estimated").otherwise("data"))
        .when(F.col("seen") & ~F.col("supported"), "unsupported")
        .when(F.col("seen"), "no usage data")
        .otherwise("not detected")
    )
    return (
        dim.join(found, "agent_id", "left")
        .join(detected.select("agent_id", F.lit(True).alias("seen")).distinct(), "agent_id", "left")
        .select(
            "agent_id",
            "name",
            F.coalesce("projects", F.lit(0)).alias("projects"),
            F.coalesce("sessions", F.lit(0)).alias("sessions"),
            F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
            status.alias("status"),
            F.when(F.col("seen"), F.col("unsupported_reason")).alias("reason"),
        )
    )
