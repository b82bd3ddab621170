"""Entity KPIs: Pareto, quintiles, percent ranks, concentration, central tendency.

Entity totals are one map-side-combined aggregate.  They are staged because the
ordered scan reads them several times; there is one row per entity.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.cells import col, number, present
from ..staging import stage
from . import ordered
from .joins import share_of, with_constants
from .quantiles import exact_quantiles


def entity_totals(df: DataFrame, entity: str, amount: str, *, skip_blank: bool = False) -> DataFrame:
    kept = df.where(present(df, amount)) if skip_blank else df
    return kept.groupBy(col(entity)).agg(F.sum(number(df, amount)).alias("total"))


def _grand_total(totals: DataFrame) -> DataFrame:
    return totals.agg(F.sum("total").alias("__grand"))


def pareto(df: DataFrame, entity: str, amount: str, *, buckets: int | None = None) -> DataFrame:
    """Totals with share, cumulative share and position in percent, largest first."""
    totals = stage(entity_totals(df, entity, amount, skip_blank=True), "totals")
    ranked = ordered.scan(
        totals,
        [ordered.desc("total")],
        {
            "__rank": ordered.row_number(),
            "__n": ordered.row_count(),
            "__running": ordered.running_sum_peers("total"),
        },
        tie=[ordered.asc(entity)],
        buckets=buckets,
    )
    return (
        with_constants(ranked, _grand_total(totals))
        .select(
            col(entity),
            F.round("total", 2).alias("total"),
            share_of(col("total"), col("__grand")).alias("pct_of_total"),
            share_of(col("__running"), col("__grand")).alias("cumulative_pct"),
            share_of(col("__rank"), col("__n")).alias("percentile_rank"),
        )
        .orderBy(F.desc_nulls_last("total"), col(entity).asc_nulls_last())
    )


def quintiles(df: DataFrame, entity: str, amount: str, tiles: int = 5, *, buckets: int | None = None) -> DataFrame:
    """Entities in equal-sized groups by total: size, sum and contribution."""
    totals = stage(entity_totals(df, entity, amount), "totals")
    ranked = ordered.scan(
        totals,
        [ordered.desc("total")],
        {"quintile": ordered.ntile(tiles)},
        tie=[ordered.asc(entity)],
        buckets=buckets,
    )
    groups = ranked.groupBy("quintile").agg(F.count(F.lit(1)).alias("entity_count"), F.sum("total").alias("__sum"))
    return (
        with_constants(groups, _grand_total(totals))
        .select(
            col("quintile").cast("long").alias("quintile"),
            "entity_count",
            F.round("__sum", 2).alias("group_total"),
            share_of(col("__sum"), col("__grand")).alias("contribution_pct"),
        )
        .orderBy("quintile")
    )


def _tier(share: Column) -> Column:
    return (
        F.when(share >= 0.9, "Top 10%").when(share >= 0.75, "Top 25%").when(share >= 0.5, "Top 50%").otherwise("Bottom 50%")
    )


def percentile_ranks(df: DataFrame, entity: str, amount: str, *, buckets: int | None = None) -> DataFrame:
    """PERCENT_RANK of each entity's total, with a tier label, largest first."""
    totals = stage(entity_totals(df, entity, amount), "totals")
    ranked = ordered.scan(
        totals, [ordered.asc("total")], {"__share": ordered.percent_rank()}, tie=[ordered.asc(entity)], buckets=buckets
    )
    return ranked.select(
        col(entity),
        F.round("total", 2).alias("total"),
        F.round(col("__share") * 100, 2).alias("percentile_rank"),
        _tier(col("__share")).alias("tier"),
    ).orderBy(F.desc_nulls_last("total"), col(entity).asc_nulls_last())


def concentration(df: DataFrame, entity: str, amount: str, tops: tuple[int, ...] = (3, 10, 25)) -> DataFrame:
    """Share of the grand total held by the largest entities."""
    totals = stage(entity_totals(df, entity, amount), "totals")
    # A top-k of max(tops) rows; the row numbers below run over those rows only.
    leaders = totals.orderBy(F.desc_nulls_last("total"), col(entity).asc_nulls_last()).limit(max(tops))
    ranked = leaders.withColumn(
        "__rank", F.row_number().over(W.orderBy(F.desc_nulls_last("total"), col(entity).asc_nulls_last()))
    )
    sums = ranked.agg(*[F.sum(F.when(col("__rank") <= k, col("total"))).alias(f"top{k}") for k in tops])
    entries = [
        F.struct(
            F.lit(f"Top {k}").alias("metric"), share_of(col(f"top{k}"), col("__grand")).alias("concentration_pct")
        )
        for k in tops
    ]
    return with_constants(sums, _grand_total(totals)).select(F.inline(F.array(*entries)))


def central_tendency(df: DataFrame, entity: str, amount: str) -> DataFrame:
    """Mean against median of the non-blank values, with rows and distinct entities."""
    kept = df.where(present(df, amount)).select(number(df, amount).alias("v"), col(entity).alias("e"))
    median = F.lit(exact_quantiles(kept, F.col("v"), (0.5,))[0]).cast("double")
    mean = F.avg("v")
    return kept.agg(
        F.round(mean, 2).alias("mean_value"),
        F.round(median, 2).alias("median_value"),
        F.round(F.try_divide((mean - median) * 100, median), 2).alias("pct_difference"),
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("e").alias("unique_entities"),
    )
