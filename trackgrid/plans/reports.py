"""Trade-off and comparison reports composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.operators import aggregates as agg
from trackgrid.operators import joins, pareto
from trackgrid.scale import materialize


def tradeoff_table(accuracy: DataFrame, runtimes: DataFrame, frames: DataFrame) -> DataFrame:
    """Accuracy, seconds and throughput of every variant on every split."""
    split = agg.runtime_per_split(agg.runtime_per_video(runtimes), frames)
    return joins.join_accuracy_runtime(accuracy, split)


def tradeoff_report(accuracy: DataFrame, runtimes: DataFrame, frames: DataFrame, metric: str = "HOTA_HOTA",
                    points: int | None = 10) -> DataFrame:
    """Front of the validation split per dataset: the parameter sets worth running on the test split.

    Only system rows of the validation split with a real classifier enter; the filter reaches both scans.
    """
    wanted = (F.col("videoset") == "valid") & (F.col("variant") != "naive") & ~F.col("classifier").eqNullSafe("Perfect")
    # One row per variant and split; written once because the front scans it twice.
    table = materialize(tradeoff_table(accuracy.where(wanted), runtimes.where(wanted), frames), "tradeoff")
    front = pareto.pareto_front(table, "time", metric, min_x=True, min_y=False, by=["dataset"])
    if points is not None:
        front = pareto.pareto_prune(front, "time", metric, points, min_x=True, by=["dataset"])
    return front


def competitor_tradeoff(stats: DataFrame, metrics: DataFrame, metric: str = "HOTA_HOTA") -> DataFrame:
    """Competitor runtimes with their metrics; a parameter set without metrics is an error.

    The sampling rate comes from the thresholds of the JSON tracker configuration.
    """
    joined = stats.join(metrics, "param_id", "left")
    checked = joined.where(F.assert_true(F.col(metric).isNotNull(), "parameter set without accuracy").isNull())
    if "tracker_cfg" in stats.columns:
        rate = agg.max_gap(F.from_json("tracker_cfg", "Thresholds array<double>")["Thresholds"])
    else:
        rate = F.lit(1).cast("bigint")
    return checked.withColumns({"sample_rate": rate, "time": F.col("runtime")})


def align_systems(ours: DataFrame, rivals: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """One table of all systems in our schema; what a competitor lacks is NULL."""
    out = ours.withColumn("system", F.lit("ours"))
    for name, table in rivals.items():
        if "variant_id" not in table.columns:
            table = table.withColumn("variant_id", F.concat(F.lit(name + "_"), F.col("param_id").cast("string")))
        kept = [c for c in columns if c in table.columns]
        out = out.unionByName(table.select(*kept, F.lit(name).alias("system")), allowMissingColumns=True)
    return out.select(*columns, "system")
