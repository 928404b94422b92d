"""Case status from a stream of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.events import STAGES


def _bit() -> Column:
    """A bit for each approved or edited stage, and one above them for a rejection."""
    out = F.when(F.col("status") == "reject", 1 << len(STAGES))
    for k, stage in enumerate(STAGES):
        out = out.when(F.col("status").isin("approve", "edit") & (F.col("stage") == stage), 1 << k)
    return out.otherwise(0)


def status_stream(decisions: DataFrame) -> DataFrame:
    """(case_id, status, next_stage) of each case that a batch touches (update mode), as case_status gives
    it. The state of a case is one number."""
    bits = decisions.groupBy("case_id").agg(F.bit_or(_bit()).alias("bits"))
    rejected, held = F.shiftright("bits", len(STAGES)) > 0, F.col("bits")
    left = F.coalesce(*[F.when(F.shiftright(held, k).bitwiseAND(1) == 0, s) for k, s in enumerate(STAGES)])
    status = F.when(rejected, "rejected").when(left.isNull(), "complete").otherwise("awaiting_decision")
    return bits.select("case_id", status.alias("status"), F.when(~rejected, left).alias("next_stage"))
