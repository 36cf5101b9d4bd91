"""Time frame of one run: plain values that become literals in every plan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def _midnight_micros(day: date) -> int:
    at = datetime.combine(day, time.min, tzinfo=timezone.utc)
    return int(at.timestamp()) * 1_000_000


@dataclass(frozen=True)
class RunContext:
    """The data's own "today" and the horizons measured back from it.

    Churn features are taken at ``cutoff_date``; taste features and the log window end at
    ``reference_date``. Both are midnights, UTC.
    """

    reference_date: date
    cutoff_days: int = 90
    window_days: int = 30

    @property
    def cutoff_date(self) -> date:
        return self.reference_date - timedelta(days=self.cutoff_days)

    @property
    def reference_micros(self) -> int:
        return _midnight_micros(self.reference_date)

    @property
    def cutoff_micros(self) -> int:
        return _midnight_micros(self.cutoff_date)

    def reference(self, back_days: int = 0) -> Column:
        """Midnight of the reference day, moved back; a folded timestamp literal."""
        return F.timestamp_micros(F.lit(self.reference_micros - back_days * 86_400_000_000))

    def cutoff(self, back_days: int = 0) -> Column:
        return F.timestamp_micros(F.lit(self.cutoff_micros - back_days * 86_400_000_000))

    def in_window(self, ts: Column) -> Column:
        """The closed log window: activity later on the reference day itself stays out."""
        return ts.between(self.reference(self.window_days), self.reference())
