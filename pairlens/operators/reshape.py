"""Wide and long corpus forms, column order and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.fixed_values import (
    EXPECTED_LABEL, REVIEW_COLUMNS, STRATEGY_NAMES, VARIANT_COLUMNS, VARIANTS)


def variant_rows(corpus: DataFrame, referent_fallback: bool) -> DataFrame:
    """One row per (row_id, variant) with sentence, referent and gold label; nothing filtered.

    The three structs are exploded in place, so no shuffle is needed.
    """

    def entry(variant: str) -> Column:
        sentence, referent = VARIANT_COLUMNS[variant]
        named = F.col(referent)
        if referent_fallback and referent != "referent":
            named = F.coalesce(named, F.col("referent"))
        return F.struct(
            F.lit(variant).alias("variant"), F.col(sentence).alias("sentence"),
            named.alias("referent"), F.lit(EXPECTED_LABEL[variant]).alias("expected_label"))

    exploded = corpus.select("row_id", F.explode(F.array(*[entry(v) for v in VARIANTS])).alias("v"))
    return exploded.select("row_id", "v.*")


def to_long(corpus: DataFrame) -> DataFrame:
    """Classification examples: the source always, a rewrite only if it is there."""
    rows = variant_rows(corpus, referent_fallback=True)
    return rows.where((F.col("variant") == "source") | F.col("sentence").isNotNull())


def to_wide(long: DataFrame, values: dict[str, str], variants=VARIANTS) -> DataFrame:
    """One row per ``row_id`` with a column per value and variant.

    ``values`` maps a long column to the prefix of its wide columns. A second row of the same
    variant replaces the first in a fixed order instead of an arbitrary one.
    """
    packed = F.struct(*list(values))
    wide = long.where(F.col("variant").isin(*variants)).groupBy("row_id").agg(*[
        F.max(F.when(F.col("variant") == v, packed)).alias(f"_{v}") for v in variants])
    return wide.select("row_id", *[
        F.col(f"_{v}")[column].alias(f"{prefix}_{v}") for v in variants for column, prefix in values.items()])


def review_order(df: DataFrame, preferred=REVIEW_COLUMNS) -> DataFrame:
    """Preferred columns first, the rest in their old order."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def strategy_display(strategy: Column, names: dict[str, tuple[str, str]] | None = None) -> Column:
    """struct<display, cue_group> of a strategy; unknown names give a null struct."""
    names = STRATEGY_NAMES if names is None else names
    pairs = [part for name, (display, group) in names.items() for part in (
        F.lit(name), F.struct(F.lit(display).alias("display"), F.lit(group).alias("cue_group")))]
    return F.try_element_at(F.create_map(*pairs), strategy)
