"""The whole evaluation of a prediction table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators import metrics as M


def evaluate_runs(predictions: DataFrame, attributes: DataFrame, flags=(
        "filter_any", "filter_multi_sentence", "filter_pre_gendered"), by=M.RUN) -> dict[str, DataFrame]:
    """All per-run tables, by name.

    Predictions and test-row attributes are joined once; the caller may persist the result of
    ``joined`` when many tables are written.
    """
    joined = M.attach_attributes(predictions, attributes)
    tables = {
        "joined": joined,
        "overall": M.overall(joined, by),
        "confusion": M.confusion(joined, by),
        "prf": M.prf(joined, by),
        "by_strategy": M.accuracy_by_strategy(joined, by),
        "by_flag": M.accuracy_by_flag(joined, flags, by),
        "calibration": M.calibration(joined, by),
        "bias": M.bias_table(joined, by),
    }
    if "accepted" in attributes.columns:
        tables["by_acceptance"] = M.accuracy_by_acceptance(joined, by)
    return tables


def write_evaluation(tables: dict[str, DataFrame], folder: str, persist: bool = True) -> None:
    """Write every table below ``folder``; the joined rows are kept in memory or on disk meanwhile."""
    joined = tables["joined"]
    if persist:
        joined.persist()
    try:
        for name, table in tables.items():
            if name != "joined":
                table.write.mode("overwrite").parquet(f"{folder}/{name}")
    finally:
        if persist:
            joined.unpersist()


def attribute_table(corpus: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Test-row attributes for the slices: strategy and whatever flags the corpus has."""
    wanted = ("filter_any", "filter_multi_sentence", "filter_pre_gendered", "accepted", *extra)
    return corpus.select("row_id", F.col("eval_strategy_label").alias("strategy"),
                         *[c for c in wanted if c in corpus.columns])
