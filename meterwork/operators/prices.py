"""Model id to price (C1, J1) and the price catalog tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pricing import (
    FALLBACK_KEY,
    FALLBACK_PREFIX,
    PRICE_FIELDS,
    STATIC_PRICES,
    cache_savings,
    cost_columns,
)
from ..session import stage
from .dedup import keep_first

_SEED = {row[0]: row for row in STATIC_PRICES}
_FREE = ("", 0.0, 0.0, None, None)


def _literal(row) -> str:
    """SQL text of a price struct: one call to the JVM per expression, however many rows the table has."""
    values = [*row[1:], None][: len(PRICE_FIELDS)]
    fields = ", ".join(f"'{n}', CAST({'NULL' if v is None else v} AS DOUBLE)" for n, v in zip(PRICE_FIELDS, values))
    return f"named_struct({fields})"


def static_prefix_price(model: str = "model") -> Column:
    """Longest seed key the model starts with; NULL if none. A projection: no join, no shuffle."""
    cases = " ".join(
        f"WHEN startswith({model}, '{key}') THEN {_literal(_SEED[key])}" for key in sorted(_SEED, key=len, reverse=True)
    )
    return F.expr(f"CASE {cases} END")


def fallback_price(model: str = "model") -> Column:
    return F.expr(f"CASE WHEN startswith({model}, '{FALLBACK_PREFIX}') THEN {_literal(_SEED[FALLBACK_KEY])} ELSE {_literal(_FREE)} END")


def resolve_live(models: DataFrame, live: DataFrame) -> DataFrame:
    """(model, exact, prefix): the live price under the model's own name and under its longest live prefix.

    A model's prefixes are exploded and joined on equality, so neither side has
    to be broadcast; Spark picks the join from measured sizes.
    """
    length = F.length("model")
    prefixes = models.select("model").distinct().filter(length > 0).select(
        "model", F.explode(F.sequence(F.lit(1), length)).alias("n")
    ).select("model", "n", F.substr("model", F.lit(1), "n").alias("key"))
    found = prefixes.join(live.select("key", F.struct(*PRICE_FIELDS).alias("price")), "key")
    return found.groupBy("model").agg(
        F.max(F.when(F.col("key") == F.col("model"), F.col("price"))).alias("exact"),
        F.max_by("price", "n").alias("prefix"),
    )


def with_price(df: DataFrame, live: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """Add ``price`` to rows with a ``model``.

    Order: live exact name, seed prefix, live prefix, then the fallback. Use it
    on aggregated rows. With a live table the rows are staged, for their model
    names and for themselves, unless ``models`` gives the distinct names.
    """
    if live is None:
        return df.withColumn("price", F.coalesce(static_prefix_price(), fallback_price()))
    df = stage(df, "to-price") if models is None else df
    resolved = resolve_live(df if models is None else models, live)
    return (
        df.join(resolved, "model", "left")
        .withColumn("price", F.coalesce("exact", static_prefix_price(), "prefix", fallback_price()))
        .drop("exact", "prefix")
    )


def with_cost(df: DataFrame, live: DataFrame | None = None, models: DataFrame | None = None) -> DataFrame:
    """C2 and C3 on rows with a model and summed measures."""
    priced = with_price(df, live, models)
    return priced.select(
        *df.columns,
        *[c.alias(n) for n, c in cost_columns(F.col("price")).items()],
        cache_savings(F.col("price")).alias("cache_savings_usd"),
    )


def catalog_prices(entries: DataFrame) -> DataFrame:
    """Per-token catalog rows (pos, key, entry VARIANT) to a price table per million tokens.

    A bare name beats a provider-prefixed one and the first prefixed one beats
    later ones. A missing write price means free writes, except for the
    fallback vendor's models, which keep the default.
    """
    from ..functions import coerce as c

    def cost(field: str) -> Column:
        return c.number(c.get("entry", f"$.{field}"))

    name = F.substring_index("key", "/", -1)
    # A repeated prefixed key never replaces; a bare key always does.
    rows = entries.select(
        name.alias("name"),
        F.col("key").contains("/").alias("prefixed"),
        "pos",
        cost("input_cost_per_token").alias("i"),
        cost("output_cost_per_token").alias("o"),
        cost("cache_read_input_token_cost").alias("r"),
        cost("cache_creation_input_token_cost").alias("w"),
        cost("cache_creation_input_token_cost_above_1hr").alias("h"),
    ).filter((F.col("i") > 0) & F.col("o").isNotNull())
    best = keep_first(rows, ["name"], ["prefixed", "pos"])
    write = F.when(F.col("w").isNotNull(), F.col("w") / F.col("i")).when(~F.col("name").startswith(FALLBACK_PREFIX), F.lit(0.0))
    return best.select(
        F.col("name").alias("key"),
        (F.col("i") * 1e6).alias("input_per_mtok"),
        (F.col("o") * 1e6).alias("output_per_mtok"),
        (F.col("r") / F.col("i")).alias("cache_read_mult"),
        write.alias("cache_write_mult"),
        (F.col("h") / F.col("i")).alias("cache_write_1h_mult"),
    )


def catalog_entries(documents: DataFrame) -> DataFrame:
    """Rows of a catalog document (one JSON object per row of ``value``) in key order.

    ``map<string,string>`` keeps the document's key order, which VARIANT does not.
    """
    whole = F.from_json("value", "map<string,string>")
    return documents.select(F.posexplode(F.map_entries(whole)).alias("pos", "e")).select(
        "pos", F.col("e.key").alias("key"), F.try_parse_json("e.value").alias("entry")
    )


def choose_snapshot(snapshots: DataFrame, as_of_ms: int, max_age_ms: int | None = 24 * 3_600_000) -> DataFrame:
    """Prices of the newest snapshot not older than ``max_age_ms`` at ``as_of_ms``; None takes any age (offline)."""
    usable = F.col("fetched_at") <= as_of_ms
    if max_age_ms is not None:
        usable &= F.col("fetched_at") > as_of_ms - max_age_ms
    fresh = snapshots.filter(usable)
    newest = fresh.agg(F.max("fetched_at").alias("fetched_at"))
    return fresh.join(newest, "fetched_at", "left_semi").drop("fetched_at")
