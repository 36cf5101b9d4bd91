"""Fresh scores against stored out-of-fold scores: keep the stored one unless it drifted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.rules import TARGETS, probability


def reconcile(
    live: DataFrame, oof: DataFrame, threshold: float = 0.10, targets: Sequence[str] = TARGETS
) -> DataFrame:
    """Per target: live, oof, delta, source, final. A delta equal to the threshold is stable.

    A stored score whose live one is missing has the source ``unknown`` and no final score.
    """
    present = [t for t in targets if probability(t) in live.columns]
    renamed = live.withColumnsRenamed({probability(t): f"{t}_live" for t in present})
    stored = oof.select(
        "user_id", *[F.col(f"{probability(t)}_oof").alias(f"{t}_oof") for t in present]
    )
    joined = renamed.join(stored, "user_id", "left")
    for t in present:
        fresh, kept = F.col(f"{t}_live"), F.col(f"{t}_oof")
        delta = fresh - kept
        stable = F.abs(delta) <= threshold
        joined = joined.withColumns({
            f"{t}_delta": delta,
            f"{t}_source": F.when(kept.isNull(), "live_new").when(fresh.isNull(), "unknown")
            .when(stable, "oof_stable").otherwise("live_drift"),
            f"{t}_final": F.when(stable, kept).otherwise(fresh),
        })
    columns = ["user_id"]
    for t in present:
        columns += [f"{t}_{part}" for part in ("live", "oof", "delta", "source", "final")]
    return joined.select(*columns)
