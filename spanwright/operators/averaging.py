"""Means of models that tasks trained, merged a few at a time: what a round of training over all rows ends with."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.operators.lineage import cut

#: Models that one task averages.
MERGED = 8
PART = "n long, loss double, steps long, flat array<double>"


def averaged(parts: DataFrame) -> tuple[int, float, int, np.ndarray] | None:
    """Sentences, mean loss, most steps and mean weights over ``parts``, merged a few at a time."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        share = n / n.sum()
        flat = sum(s * np.asarray(x.values) for s, x in zip(share, group.column("flat"), strict=True))
        return pa.table({"n": [int(n.sum())], "loss": [float(share @ group.column("loss").to_numpy())], "steps": [max(group.column("steps").to_pylist())], "flat": pa.array([flat], pa.list_(pa.float64()))})

    parts = cut(parts)
    left = parts.count()
    while left > 1:
        g = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-left // MERGED))).cast("int")
        parts = cut(parts.withColumn("g", g).groupBy("g").applyInArrow(run, PART))
        left = parts.count()
    row = parts.first()
    return (row["n"], row["loss"], row["steps"], np.array(row["flat"])) if row else None
