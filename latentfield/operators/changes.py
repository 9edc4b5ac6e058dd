"""A stored baseline against the present (JN17, FLT13, SCL25)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def compared(before: DataFrame, now: DataFrame) -> DataFrame:
    """Changes of each capability that both have, and the verdict on them. Both: capability, correction, utilization, collapse_potential."""
    b = before.select("capability", *(F.col(c).alias(f"b_{c}") for c in ("correction", "utilization", "collapse_potential")))
    joined = now.select("capability", "correction", "utilization", "collapse_potential").join(b, "capability")
    change = {f"d_{c}": F.col(c) - F.col(f"b_{c}") for c in ("collapse_potential", "correction", "utilization")}
    return joined.select("capability", *(v.alias(k) for k, v in change.items())).withColumn("verdict", S.change_verdict(F.col("d_collapse_potential"), F.col("d_utilization")))
