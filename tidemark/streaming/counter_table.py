"""Mergeable counters in a folder, kept by micro-batches.

Layout below the folder::

    deltas/batch=<id>/              what one micro-batch adds; a repeated batch replaces its own
    base/upto=<id>/day=<day>/       the sums of a day over all batches up to that one

A day's newest complete base and the deltas after the newest compaction are its value. A compaction
folds only the days that the new deltas name, so its cost follows what arrived, not what is kept.
Days older than the retention go without being read. The batch id is all the state there is, so a
batch that is repeated after a failure, at any step, leaves the same counters.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_FIRST, _LAST = "0001-01-01", "9999-12-31"


@dataclass(frozen=True)
class CounterTable:
    """``keys`` (``day`` is added) name a counter, ``sums`` are what adds up. Days are dates.

    ``compact_every`` batches are folded at once; ``keep_days`` before the newest day are kept, all
    of them if it is None.
    """

    spark: SparkSession
    folder: str
    keys: T.StructType
    sums: tuple[str, ...]
    compact_every: int = 8
    keep_days: int | None = None

    @property
    def schema(self) -> T.StructType:
        fields = [*self.keys.fields, *[T.StructField(s, T.LongType()) for s in self.sums]]
        return T.StructType([*fields, T.StructField("day", T.DateType())])

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _parts(self, path: str, name: str) -> list[str]:
        """Values of the folders ``name=<value>`` in a folder."""
        fs, at = self._fs(path)
        if not fs.exists(at):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
        return sorted(x.split("=", 1)[1] for x in found if x.startswith(f"{name}="))

    def _complete(self, kind: str, name: str) -> list[int]:
        out = []
        for value in self._parts(f"{self.folder}/{kind}", name):
            fs, mark = self._fs(f"{self.folder}/{kind}/{name}={value}/_SUCCESS")
            if fs.exists(mark):
                out.append(int(value))
        return sorted(out)

    def _delete(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)

    def _base_days(self) -> dict[str, int]:
        """{day: the newest compaction that holds it}"""
        held: dict[str, int] = {}
        for upto in self._complete("base", "upto"):
            for day in self._parts(f"{self.folder}/base/upto={upto}", "day"):
                held[day] = upto
        return held

    def _folded(self) -> int:
        return max(self._complete("base", "upto"), default=-1)

    def _deltas(self) -> list[int]:
        folded = self._folded()
        return [b for b in self._complete("deltas", "batch") if b > folded]

    def _oldest(self, days: list[str]) -> str:
        """The first day that is kept, given all days there are."""
        if self.keep_days is None or not days:
            return _FIRST
        return str(date.fromisoformat(max(days)) - timedelta(days=self.keep_days))

    def _read(self, paths: list[str], kind: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)
        return rows.select(*self.schema.fieldNames())

    def _read_deltas(self, batches: list[int]) -> tuple[DataFrame, list[str]]:
        """Rows of deltas and the days they name."""
        rows = self._read([f"{self.folder}/deltas/batch={b}" for b in batches], "deltas")
        return rows, [str(r[0]) for r in rows.select("day").distinct().collect()]

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys.fieldNames(), "day").agg(*[F.sum(s).alias(s) for s in self.sums])

    def add(self, counters: DataFrame, batch: int) -> None:
        """One micro-batch: its own counters, one row per counter. Rows without a day go."""
        if batch <= self._folded():
            return
        rows = counters.where(F.col("day").isNotNull()).select(*self.schema.fieldNames())
        rows.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        if len(self._deltas()) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """Fold all deltas into the days they name, then remove what is no longer needed."""
        deltas = self._deltas()
        if deltas:
            new, named = self._read_deltas(deltas)
            held = self._base_days()
            oldest = self._oldest([*named, *held])
            paths = [f"{self.folder}/base/upto={held[d]}/day={d}" for d in sorted({*named} & held.keys()) if d >= oldest]
            kept = new.where(F.col("day") >= F.lit(oldest).cast("date"))
            rows = self._summed(self._read(paths, "base").unionByName(kept)).hint("rebalance", "day")
            rows.write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/base/upto={max(deltas)}")
        self._clean()

    def _clean(self) -> None:
        held, folded = self._base_days(), self._folded()
        oldest = self._oldest([*held])
        for upto in self._complete("base", "upto"):
            root = f"{self.folder}/base/upto={upto}"
            days = self._parts(root, "day")
            gone = [d for d in days if held[d] != upto or d < oldest]
            if len(gone) == len(days) and upto != folded:
                self._delete(root)
            else:
                for d in gone:
                    self._delete(f"{root}/day={d}")
        for b in self._parts(f"{self.folder}/deltas", "batch"):
            if int(b) <= folded:
                self._delete(f"{self.folder}/deltas/batch={b}")

    def read(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Current counters, of the days from ``first`` to ``last``; other days are not opened."""
        held, (new, named) = self._base_days(), self._read_deltas(self._deltas())
        low = max(self._oldest([*held, *named]), str(first or _FIRST))
        high = str(last or _LAST)
        base = [f"{self.folder}/base/upto={u}/day={d}" for d, u in sorted(held.items()) if low <= d <= high]
        inside = F.col("day").between(F.lit(low).cast("date"), F.lit(high).cast("date"))
        return self._summed(self._read(base, "base").unionByName(new.where(inside)))
