"""Energy reports of job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwise.functions.rounding import fixed

RECENT_RUNS = 40


def energy_units(logs: DataFrame) -> DataFrame:
    """kWh to Wh and kg to mg."""
    wh = {
        name.replace("_kwh", "_wh"): F.col(name) * 1000.0
        for name in ("energy_kwh", "cpu_energy_kwh", "gpu_energy_kwh", "ram_energy_kwh")
    }
    return logs.withColumns({**wh, "co2_mg": F.col("co2_kg") * 1_000_000.0})


def energy_by_pipeline(energy: DataFrame) -> DataFrame:
    return (
        energy.filter(F.col("pipeline_name").isNotNull())
        .groupBy("pipeline_name")
        .agg(
            F.sum("energy_wh").alias("total_wh"),
            F.sum("co2_mg").alias("total_co2_mg"),
            F.count_distinct("run_id").alias("runs"),
            F.sum("duration_s").alias("total_duration_s"),
        )
        .orderBy(F.desc("total_wh"), "pipeline_name")
    )


def energy_by_node(energy: DataFrame) -> DataFrame:
    return (
        energy.filter(F.col("pipeline_name").isNotNull() & F.col("node_name").isNotNull())
        .groupBy("pipeline_name", "node_name")
        .agg(
            F.avg("energy_wh").alias("avg_wh"),
            F.sum("energy_wh").alias("total_wh"),
            F.avg("cpu_energy_wh").alias("avg_cpu_wh"),
            F.avg("gpu_energy_wh").alias("avg_gpu_wh"),
            F.avg("ram_energy_wh").alias("avg_ram_wh"),
            F.avg("duration_s").alias("avg_duration_s"),
            F.count("run_id").alias("runs"),
        )
        .orderBy(F.desc("total_wh"), "pipeline_name", "node_name")
    )


def energy_timeline(energy: DataFrame) -> DataFrame:
    keys = ["run_id", "pipeline_name", "timestamp"]
    return (
        energy.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.sum("energy_wh").alias("total_wh"), F.sum("co2_mg").alias("total_co2_mg"))
        .orderBy("timestamp", "run_id", "pipeline_name")
    )


def energy_kpis(energy: DataFrame) -> DataFrame:
    """One row: total energy, total CO2, distinct runs and the heaviest node."""
    heaviest = energy_by_node(energy).select("node_name").limit(1).scalar()
    return energy.agg(
        F.sum("energy_wh").alias("total_wh"),
        F.sum("co2_mg").alias("total_co2_mg"),
        F.count_distinct("run_id").alias("total_runs"),
    ).select("*", heaviest.alias("heaviest_node"))


def energy_breakdown(by_node: DataFrame) -> DataFrame:
    """(node, component, avg_wh) rows from the columns of the node report."""
    renamed = by_node.select(
        "node_name",
        F.col("avg_cpu_wh").alias("CPU"),
        F.col("avg_ram_wh").alias("RAM"),
        F.col("avg_gpu_wh").alias("GPU"),
    )
    return renamed.unpivot("node_name", ["CPU", "RAM", "GPU"], "component", "avg_wh")


def recent_runs(energy: DataFrame, shown: int = RECENT_RUNS) -> DataFrame:
    """Newest rows as display text; rows of one instant in the order of run and node."""
    newest = energy.orderBy(F.desc("timestamp"), "run_id", "node_name").limit(shown)
    return newest.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.col("pipeline_name").alias("pipeline"),
        F.col("node_name").alias("node"),
        fixed(F.col("energy_wh"), 4).alias("energy_wh"),
        fixed(F.col("co2_mg"), 3).alias("co2_mg"),
        fixed(F.col("duration_s"), 2).alias("duration_s"),
    )
