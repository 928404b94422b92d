"""Case event logs: stage durations, status, edits, decision records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("triage", "risk", "guideline", "letter")


def stage_durations(audit: DataFrame) -> DataFrame:
    """(case_id, stage, duration_ms) of the first entry of each stage."""
    ms = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    first = Window.partitionBy("case_id", "stage").orderBy("started_at", "completed_at")
    return audit.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("case_id", "stage", ms.alias("duration_ms"))


def case_status(decisions: DataFrame, stages: tuple[str, ...] = STAGES, invalid: DataFrame | None = None) -> DataFrame:
    """(case_id, status, next_stage): rejected once any stage was, complete when all are approved or
    edited, else awaiting the first stage that is not. A case of invalid (case ids whose triage failed)
    has ended as failed, whatever was decided, and is listed without decisions too."""
    done = F.array_distinct(F.collect_set(F.when(F.col("status").isin("approve", "edit"), F.col("stage"))))
    held = decisions.groupBy("case_id").agg(done.alias("done"), F.bool_or(F.col("status") == "reject").alias("rejected"))
    open_ = F.filter(F.array(*[F.lit(s) for s in stages]), lambda s: ~F.array_contains("done", s))
    status = F.when(F.coalesce("rejected", F.lit(False)), "rejected").when(F.size(open_) == 0, "complete").otherwise("awaiting_decision")
    out = held.select("case_id", status.alias("status"), F.when(status == "awaiting_decision", open_[0]).alias("next_stage"))
    if invalid is None:
        return out
    bad = invalid.select("case_id").distinct().withColumn("_bad", F.lit(True))
    ended = F.col("_bad").isNotNull()
    return out.join(bad, "case_id", "full_outer").select("case_id", F.when(ended, "failed").otherwise(F.col("status")).alias("status"), F.when(~ended, F.col("next_stage")).alias("next_stage"))


def edited_fields(decisions: DataFrame, ignored: str = "risk") -> DataFrame:
    """(case_id, field, value): each field's last edit; edits to the ignored stage have no effect."""
    rows = decisions.where((F.col("status") == "edit") & (F.col("stage") != ignored)).select("case_id", "ts", F.explode("edits").alias("field", "value"))
    return rows.groupBy("case_id", "field").agg(F.max_by("value", F.struct("ts", "value")).alias("value"))


def apply_edits(artefacts: DataFrame, decisions: DataFrame, ignored: str = "risk") -> DataFrame:
    """artefacts (case_id, fields map) with the last edits in place of what they had."""
    edits = edited_fields(decisions, ignored).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_e"))
    merged = F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key(F.col("_e"), k)), F.col("_e"))
    return artefacts.join(edits, "case_id", "left").withColumn("fields", F.when(F.col("_e").isNull(), F.col("fields")).otherwise(merged)).drop("_e")


def decision_records(decisions: DataFrame) -> DataFrame:
    past = F.create_map(*[F.lit(x) for x in ("approve", "approved", "edit", "edited", "reject", "rejected")])
    return decisions.select("case_id", "stage", F.try_element_at(past, F.col("status")).alias("status"), "actor", "ts", F.coalesce("note", "reason").alias("note"))
