"""Mixing sources to target weights by Pareto order sampling; DataFrame and SQL functions only.

Every source gets a target number of words, and every document an expected number of copies: in proportion to its
weight (``long_weight`` for documents of ``long_words`` words or more, else 1), scaled so that the expected words of the
source are its target, and at most ``max_copies``. The whole part of that number is taken for certain. Its fraction p is
the document's inclusion probability in a fixed-size sample: each document draws u from a hash of its id and text, and
documents are taken in the order of (u / (1 - u)) / (p / (1 - p)) until the sampled words are as near to what the target
still lacks as whole documents allow. Size is counted in words, so the sample is fixed in words.

A source that holds a third of all rows never meets in one task: ranks are found by two rounds of binned sums
(4096 bins each, partial sums before every shuffle) and an exact pass over the one narrow bin where the sum is
reached. What comes out is one threshold per source, which every row then compares itself with.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source of its own, ranked last;
of rows of equal id and text the second and later ones draw by their number too, so they are told apart; an empty table
gives an empty one; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwork.llm.common import WORD, join_side, numbered, packed, staged_small, unpacked
from meterwork.session import stage

BINS = 4096
#: md5 gives 52 of its bits, which a double holds exactly.
_DRAW_HEX, _DRAW_RANGE = 13, float(1 << 52)


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order, repeating; null comes last."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0
    max_copies: int = 3
    seed: str = "mix"
    id_column: str = "doc_id"
    text_column: str = "text"
    source_column: str = "source"
    long_words: int = 100
    long_weight: int = 2
    odds_weight: str | None = None  # a column of positive numbers that the inclusion odds are multiplied with


def _draw(mix: Mix, nth: Column | None = None) -> Column:
    """A number between 0 and 1 from id and text, and for the second and later rows of both from their number."""
    parts = [F.lit(f"{mix.seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("_text"), F.lit(""))]
    if nth is not None:
        parts.append(F.when(nth > 1, F.concat(F.lit(":"), nth.cast("string"))).otherwise(F.lit("")))
    whole = F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, _DRAW_HEX), 16, 10).cast("bigint")
    return (whole + F.lit(0.5)) / F.lit(_DRAW_RANGE)


def measured(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs(_row, _id, _source, _text, _odds)`` with ``_size`` (words), ``_weight`` and ``_draw`` (0 to 1), without the text.

    Rows of equal id and text are found on the narrow draws; only they are written down and numbered.
    """
    size = F.coalesce(F.regexp_count(F.col("_text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    weight = F.when(F.col("_size") >= mix.long_words, F.lit(mix.long_weight)).otherwise(F.lit(1)).cast("double")
    plain = docs.withColumn("_draw", _draw(mix))
    again, small = staged_small(docs.select(_draw(mix).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_d"), "mix-again")
    if not again.isEmpty():
        side, same = join_side(again, small), F.col("_draw") == F.col("_d")
        shared = plain.join(side, same, "left_semi").withColumn("_key", F.col("_draw").cast("string"))
        told = numbered(shared, "_key", "mix-repeated").withColumn("_draw", _draw(mix, F.col("_nth"))).drop("_key", "_nth")
        plain = plain.join(side, same, "left_anti").unionByName(told)
    return plain.withColumn("_size", size).withColumn("_weight", weight).drop("_text")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size) -> target: shares by weight, stopped at max_copies * size, the excess reshared.

    Resharing until no source is above its cap ends at min(cap, level * weight) for one level. Ordered by
    cap / weight, the sources at their cap come first, so running sums over the source table give the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(int(w)).cast("bigint") for w in mix.weights])
    ranked = sources.select(
        "source", "source_size",
        F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(mix.weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * mix.max_copies).alias("cap"),
    )
    by_ratio = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*by_ratio).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*by_ratio).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) * F.lit(float(mix.share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(onward)
        ).alias("level"),
    )
    free = F.col("level") <= F.col("cap") / F.col("weight")
    leveled = levels.select("*", F.min_by("level", F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")))).over(everything).alias("common"))
    return leveled.select(
        "source", "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight")), F.col("cap").cast("double")).alias("target"),
    )


def _rank(draw: Column, p: Column, odds: Column) -> Column:
    """Random odds over inclusion odds."""
    return (draw / (F.lit(1.0) - draw)) / (p / (F.lit(1.0) - p) * odds)


def expected_copies(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, light, heavy, target) -> expected copies of light and heavy documents, whole and fraction.

    Copies are ``level`` * weight; where that would exceed ``max_copies``, heavy documents stop there and the light
    ones take what is left of the target.
    """
    w, most = float(mix.long_weight), float(mix.max_copies)
    level = F.col("target") / (F.col("light") + F.col("heavy") * w)
    capped = level * w > most
    heavy = F.when(F.col("heavy") == 0, 0.0).when(capped, most).otherwise(level * w)
    light = F.when(F.col("light") == 0, 0.0).when(capped, (F.col("target") - F.col("heavy") * most) / F.col("light")).otherwise(level)
    found = sources.select("source", "source_size", "target", "light", "heavy", light.alias("light_copies"), heavy.alias("heavy_copies"))
    bounded = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(most))
    parts = found.select("*", *[F.floor(bounded(f"{k}_copies")).cast("bigint").alias(f"{k}_whole") for k in ("light", "heavy")],
                         *[(bounded(f"{k}_copies") - F.floor(bounded(f"{k}_copies"))).alias(f"{k}_rest") for k in ("light", "heavy")])
    certain = F.col("light") * F.col("light_whole") + F.col("heavy") * F.col("heavy_whole")
    return parts.select("source", "source_size", "target", "light_whole", "heavy_whole", "light_rest", "heavy_rest", (F.col("target") - certain).alias("rest_words"))


def _reached(sums: DataFrame, by: str) -> DataFrame:
    """Per source the first ``by`` at which the running sum of ``words`` reaches ``rest_words``, and the sum before it."""
    up_to = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.select("*", (F.col("done") + F.sum("words").over(up_to)).alias("upto"))
    return (
        run.filter(F.col("upto") >= F.col("rest_words"))
        .groupBy("source").agg(F.min_by(F.struct(by, (F.col("upto") - F.col("words")).alias("done"), "upto", "rest_words"), by).alias("hit"))
        .select("source", "hit.*")
    )


def fit(rows: DataFrame, mix: Mix) -> tuple[DataFrame, bool]:
    """Per source: size, target, whole copies and the threshold of the sample. ``rows``: ``measured``, best staged.

    Returns the staged table and whether it may be broadcast.
    """
    narrow = rows.select(F.col("_source").alias("source"), "_size", "_draw", "_weight", "_odds")
    is_heavy = F.col("_weight") > 1
    of = lambda heavy: F.coalesce(F.sum(F.when(is_heavy == heavy, F.col("_size"))), F.lit(0)).cast("bigint")
    sizes = narrow.groupBy("source").agg(F.sum("_size").cast("bigint").alias("source_size"), of(False).alias("light"), of(True).alias("heavy"))
    sizes = stage(sizes, "mix-sizes")
    aimed = targets(sizes, mix).select(F.col("source").alias("s"), "target")
    shares, small = staged_small(expected_copies(sizes.join(aimed, F.col("source").eqNullSafe(F.col("s"))), mix), "mix-targets")
    open_ = join_side(shares.filter("rest_words > 0").select(F.col("source").alias("s"), "light_rest", "heavy_rest", "rest_words"), small)
    p = F.when(is_heavy, F.col("heavy_rest")).otherwise(F.col("light_rest"))
    ranked = narrow.filter("_size > 0").join(open_, F.col("source").eqNullSafe(F.col("s"))).filter(p > 0).select(
        "source", "rest_words", "_size", _rank(F.col("_draw"), p, F.col("_odds")).alias("q"))
    place = F.col("q") / (F.lit(1.0) + F.col("q"))
    binned = ranked.select("*", F.floor(place * BINS).alias("bin"), F.floor(place * BINS * BINS).alias("fine"))

    def inside(found: DataFrame, by: str) -> DataFrame:
        at = join_side(found.select(F.col("source").alias("s"), F.col(by).alias("b"), "done"), small)
        return binned.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col(by) == F.col("b"))).drop("s", "b")

    def sums(df: DataFrame, by: str) -> DataFrame:
        return df.groupBy("source", by).agg(F.sum("_size").alias("words"), *[F.first(c).alias(c) for c in ("rest_words", "done")])

    coarse = stage(_reached(sums(binned.withColumn("done", F.lit(0).cast("bigint")), "bin"), "bin"), "mix-bins")
    fine = stage(_reached(sums(inside(coarse, "bin"), "fine"), "fine"), "mix-bins")
    exact = _reached(sums(inside(fine, "fine"), "q"), "q").select(
        F.col("source").alias("s"), F.col("q").alias("limit"),
        (F.col("upto") - F.col("rest_words") <= F.col("rest_words") - F.col("done")).alias("inclusive"),
    )
    plan = shares.join(exact, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return stage(plan, "mix-plan"), small


def with_copies(rows: DataFrame, plan: tuple[DataFrame, bool]) -> DataFrame:
    """``rows`` (``measured``) with ``_source_size``, ``_target`` and ``_copies``: how often the mix takes the row."""
    table, small = plan
    table = table.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
                         *[F.col(c).alias(f"_{c}") for c in ("light_whole", "heavy_whole", "light_rest", "heavy_rest", "limit", "inclusive")])
    pick = lambda c: F.when(F.col("_weight") > 1, F.col(f"_heavy_{c}")).otherwise(F.col(f"_light_{c}"))
    q = F.when(pick("rest") > 0, _rank(F.col("_draw"), pick("rest"), F.col("_odds")))
    extra = F.coalesce((F.col("_size") > 0) & ((q < F.col("_limit")) | (F.col("_inclusive") & (q == F.col("_limit")))), F.lit(False))
    joined = rows.join(join_side(table, small), F.col("_source").eqNullSafe(F.col("_s")))
    return joined.withColumn("_copies", F.when(F.col("_size") > 0, pick("whole") + extra.cast("bigint")).otherwise(F.lit(0)).cast("bigint"))


def _named(mix: Mix) -> dict[str, Column]:
    odds = F.coalesce(F.col(mix.odds_weight).cast("double"), F.lit(1.0)) if mix.odds_weight else F.lit(1.0)
    return {"_id": F.col(mix.id_column), "_source": F.col(mix.source_column), "_text": F.col(mix.text_column).cast("string"), "_odds": odds}


def mix_sizes(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: id, size, source_size, target (of its source), taken words and copies."""
    rows = stage(measured(docs.select(*[c.alias(n) for n, c in _named(mix).items()]), mix), "mix-rows")
    return with_copies(rows, fit(rows, mix)).select(
        F.col("_id").alias(mix.id_column), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"),
    )


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, columns unchanged."""
    whole = measured(packed(docs, **_named(mix)), mix)
    rows = stage(whole.drop("_row"), "mix-rows")
    taken = with_copies(whole, fit(rows, mix)).filter("_copies > 0")
    return unpacked(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))))
