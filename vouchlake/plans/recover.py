"""Which inputs still need work, and a terminal row for every input."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vouchlake.operators.windows import last_wins


def check_manifest(stored: dict, expected: dict) -> None:
    if any(stored.get(k) != v for k, v in expected.items()):
        raise ValueError("resume_inputs_or_configuration_changed")


def recovered(inputs: DataFrame, journal: DataFrame, order: list[str], mode: str, violations: DataFrame | None = None) -> DataFrame:
    """The usable journal row of each input; one wrong row makes the checkpoint invalid."""
    if violations is not None and violations.limit(1).count():
        raise ValueError("resume_checkpoint_invalid")
    named = journal.join(inputs.withColumnRenamed("organisation_number", "_expected"), "input_index", "left")
    wrong = F.col("_expected").isNull() | (F.col("_expected") != F.col("organisation_number")) | (F.col("source_mode") != mode)
    fault = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("checkpoint_input_mismatch")).cast("string"))
    sound = named.withColumn("_fault", fault).filter(F.col("_fault").isNull()).drop("_fault", "_expected")
    return last_wins(sound, "input_index", order)


def resume_plan(inputs: DataFrame, journal: DataFrame, order: list[str], mode: str, violations: DataFrame | None = None) -> DataFrame:
    done = recovered(inputs, journal, order, mode, violations).select("input_index", F.lit(True).alias("_done"))
    return inputs.join(done, "input_index", "left").withColumn("pending", F.col("_done").isNull()).drop("_done")


def finalize(inputs: DataFrame, journal: DataFrame, order: list[str], mode: str, run_id: str, started_at: str, stopped: bool) -> DataFrame:
    """Rows of this run that name their input; a failed row for everything else."""
    reason = "supervisor_time_budget_exhausted" if stopped else "worker_exited_before_complete_export"
    from vouchlake.operators.windows import latest_per

    own = journal.filter((F.col("run_id") == run_id) & (F.col("source_mode") == mode) & (F.col("started_at").try_cast("timestamp") >= F.lit(started_at).cast("timestamp")))
    last = latest_per(own.join(inputs, ["input_index", "organisation_number"], "left_semi"), ["input_index"], order)
    last = last.select("input_index", F.col("state").alias("_state"))
    out = inputs.join(last, "input_index", "left")
    return out.select(
        "input_index", "organisation_number", F.coalesce("_state", F.lit("failed")).alias("state"),
        F.when(F.col("_state").isNull(), F.lit(reason)).alias("error"),
        F.when(F.coalesce("_state", F.lit("failed")) == "failed", "failed").otherwise("completed").alias("terminal_status"),
    )
