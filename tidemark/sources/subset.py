"""A referentially complete subset: some users and everything that belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import first_hex_run, wrapped_or_strict


def subset(raw: dict[str, DataFrame], n_users: int) -> dict[str, DataFrame]:
    """The first ``n_users`` by id, each table semi-joined to them.

    The fight and arena logs name characters, so they follow the kept characters instead. Rows
    and columns of the raw tables stay as they are.
    """
    users = raw["users"]
    kept = users.withColumn("_uid", wrapped_or_strict(F.col("_id"))).orderBy("_uid").limit(n_users)
    ids = kept.select("_uid").where(F.col("_uid").isNotNull())
    out = {"users": kept.drop("_uid")}
    for name, df in raw.items():
        if name in ("users", "fights_log", "arena_log"):
            continue
        out[name] = _following(df, "user_id", wrapped_or_strict, ids)
    chars = out["characters"].select(first_hex_run(F.col("_id")).alias("_uid"))
    for name, key in (("fights_log", "player_id"), ("arena_log", "attacker_id")):
        if name in raw:
            out[name] = _following(raw[name], key, first_hex_run, chars)
    return out


def _following(df: DataFrame, key: str, clean, ids: DataFrame) -> DataFrame:
    return (
        df.withColumn("_uid", clean(F.col(key)))
        .join(ids, "_uid", "left_semi").select(*df.columns)
    )
