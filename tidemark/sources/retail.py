"""Adapter: a retail star schema plus an event stream, seen as the twelve game exports.

It lets every operator run on tables of any size without the game's own data. The result has the
*raw* export shape: ids are partly wrapped as ``ObjectId('...')``, last logins and purchases are
unix seconds, and nulls are put in on purpose, because the source tables have none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.catalog import FILE_NAMES

# Event times move back by whole weeks, so that they end where the orders end.
LOG_SHIFT_DAYS = 8218
FEEDBACK_SHIFT_DAYS = 8302
# Ids from here on are no player's.
FOREIGN_IDS = 1_000_000_000


def plain_id(key: Column) -> Column:
    return F.lower(F.lpad(F.hex(key), 24, "0"))


def export_id(key: Column) -> Column:
    """A third of the ids come wrapped, as document stores export them."""
    return F.when(key % 3 == 0, F.concat(F.lit("ObjectId('"), plain_id(key), F.lit("')"))).otherwise(
        plain_id(key)
    )


def _hours(ts: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + hours * 3_600_000_000)


def _days(ts: Column, days: Column | int) -> Column:
    shift = F.lit(days) if isinstance(days, int) else days
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + shift * 86_400_000_000)


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(~cond, value)


class _Exports(Mapping):
    def __init__(self, retail: Retail) -> None:
        self._retail = retail

    def __getitem__(self, name: str) -> DataFrame:
        if name not in FILE_NAMES:
            raise KeyError(name)
        return getattr(self._retail, name)()

    def __contains__(self, name: object) -> bool:
        return name in FILE_NAMES  # without building the table

    def __iter__(self):
        return iter(FILE_NAMES)

    def __len__(self) -> int:
        return len(FILE_NAMES)


class Retail:
    """Lazy exports over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._read = spark, folder, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def last_logins(self) -> DataFrame:
        """The login times alone; every order belongs to a customer."""
        return self.orders().select(F.col("at").alias("last_login_ts"))

    def orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key, F.col("o_custkey"), F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("price"), _hours(F.col("o_orderdate"), key % 24).alias("at"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        )

    def owned_lines(self, where: Column | None = None, **columns: Column) -> DataFrame:
        """Line items as ``columns`` of them and their time ``at``, with their customer.

        Columns are made before rows travel to the orders, so only what a table holds travels.
        """
        lines = self.table("lineitem").withColumn(
            "at", _hours(F.col("l_shipdate"), F.col("l_linenumber"))
        )
        if where is not None:
            lines = lines.where(where)
        lines = lines.select("l_orderkey", *[c.alias(name) for name, c in columns.items()])
        owner = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return lines.join(owner, "l_orderkey")

    def users(self) -> DataFrame:
        seen = self.orders().groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min("at").alias("first_at"), F.max("at").alias("last_at"),
            F.count(F.lit(1)).alias("n_orders"),
        )
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        key, segment, money = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
        return (
            self.table("customer").join(seen, "c_custkey", "left")
            .join(nation, "c_nationkey", "left")
            .select(
                export_id(key).alias("_id"),
                F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
                F.unix_seconds("last_at").alias("last_login_date"),
                _null_when(F.col("c_nationkey") == 7, F.col("n_name")).alias("country"),
                F.lower(F.substring(segment, 1, 2)).alias("language"),
                F.when(money >= 0, F.when(key % 2 == 0, "pve").otherwise("pvp")).alias("focus"),
                (key % 2 == 0).alias("is_google_play"), (key % 4 != 0).alias("tutorial_done"),
                _null_when(key % 5 == 0, key % 5 == 1).alias("has_user_rated_app"),
                segment.alias("store_where_published"), money.alias("gold"),
                F.floor(money / 100).alias("gems"), F.lit(0).alias("dark_steel"),
                (key % 50).alias("runes"), F.col("n_orders").alias("num_logins"),
                _null_when(key % 25 != 0, key % 9).alias("current_session"), (key % 12).alias("last_completed_tutorial_block"),
                F.concat(F.lit("1."), (key % 3).cast("string")).alias("game_version"),
                plain_id(key + 1).alias("current_character"),
                F.lit(True).alias("template_item_stats_augment_update_done"),
            )
        )

    def characters(self) -> DataFrame:
        key, price, at = F.col("o_orderkey"), F.col("price"), F.col("at")
        talent = (key % 7) * 10

        def bit(i: int) -> Column:
            return F.shiftright(key, i).bitwiseAND(F.lit(1)) == 1

        equip = ("rHandEqObj", "lHandEqObj", "helmEqObj", "chestEqObj", "handsEqObj", "legsEqObj")
        looks = ("hairIcon", "beardIcon", "eyebrowsIcon", "faceScarIcon", "facePaintIcon",
                 "torsoScarIcon", "torsoPaintIcon")
        return self.orders().select(
            export_id(key).alias("_id"), export_id(F.col("o_custkey")).alias("user_id"),
            F.when(key % 97 == 0, F.lit(True)).when(key % 13 != 0, F.lit(False)).alias("is_npc"),
            _null_when(F.col("priority") == 5, F.col("priority") - 1).alias("class"),
            _null_when(key % 11 == 0, F.floor(price / 10000)).alias("level"),
            F.floor(price).alias("experience"),
            F.when(F.col("status") == "F", key % 5).alias("arena_category"),
            _null_when(F.col("status") == "O", key % 100).alias("medals"),
            at.alias("created_at"), _days(at, key % 60).alias("updated_at"),
            F.when(key % 6 == 0, "True").when(key % 6 == 1, "False").when(key % 6 == 2, "yes")
            .when(key % 6 == 3, "no").alias("is_customized"),
            talent.alias("total_talent_points"),
            F.least(talent, key % 37).alias("spent_talent_points"),
            F.floor(price / 100).alias("c_total_attack"),
            F.floor(price / 120).alias("c_total_defense"),
            (F.floor(price / 100) + F.floor(price / 120)).alias("c_total_attack_defense_sum"),
            _null_when(key % 8 == 0, (key % 17) / 2.0).alias("c_total_critical_chance"),
            *[F.when(bit(i), plain_id(key)).alias(c) for i, c in enumerate(equip)],
            *[
                F.when(bit(i), F.lit(i + 1)).when(bit(i + 1), F.lit(0)).alias(c)
                for i, c in enumerate(looks)
            ],
        )

    def devices(self) -> DataFrame:
        key, at, status = F.col("o_orderkey"), F.col("at"), F.col("status")
        return self.orders().select(
            export_id(F.col("o_custkey")).alias("user_id"),
            F.when(status == "F", "android").when(status == "O", "ios")
            .when(key % 2 == 1, "windows").alias("platform"),
            _null_when(key % 31 == 0, F.concat(F.lit("model-"), F.col("priority").cast("string")))
            .alias("device_model"),
            at.alias("created_at"),
            _null_when(key % 17 == 0, _days(at, key % 200)).alias("updated_at"),
        )

    def iaps_consumables(self) -> DataFrame:
        kinds = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
        bought = self.owned_lines(
            (F.col("l_discount") == 0) & (F.col("l_tax") >= 0.04), l_partkey=F.col("l_partkey"), at=F.col("at")
        )
        product = F.lower("p_type")
        return bought.join(kinds, "l_partkey").select(
            export_id(F.col("o_custkey")).alias("user_id"),
            F.when(product == "economy", F.lit("gems_economy")).otherwise(product).alias("product_id"),
            F.unix_seconds("at").alias("purchase_time"),
        )

    def iaps_subscriptions(self) -> DataFrame:
        key, at, price = F.col("o_orderkey"), F.col("at"), F.col("price")
        sold = self.orders().where((F.col("priority") <= 3) & (price > 400000))
        term = F.when(F.col("priority") == 1, 30).when(F.col("priority") == 2, 90).otherwise(365)
        return sold.select(
            export_id(F.col("o_custkey")).alias("user_id"),
            F.when(F.col("priority") == 1, "subs_monthly").when(F.col("priority") == 2, "subs_3_months")
            .otherwise("subs_12_months").alias("product_id"),
            F.unix_seconds(at).alias("purchase_time"),
            _null_when(key % 23 == 0, F.unix_seconds(_days(at, term))).alias("end_date"),
            _null_when(key % 19 == 0, (price > 450000).cast("int")).alias("is_trial"),
        )

    def daily_rewards(self) -> DataFrame:
        key, at, status = F.col("o_orderkey"), F.col("at"), F.col("status")
        day = F.day(at)
        return self.orders().select(
            export_id(key).alias("_id"), export_id(F.col("o_custkey")).alias("user_id"),
            at.alias("created_at"), _null_when(key % 29 == 0, _days(at, key % 50)).alias("updated_at"),
            F.lit(1).alias("set"), _null_when(key % 21 == 0, day - 1).alias("current_day"),
            (key % 3).alias("sets_completed"),
            F.when(key % 4 == 0, F.lit(0)).otherwise(F.least(day, F.lit(20)))
            .alias("last_claimed_reward_day"),
            F.when(key % 10 == 0, F.lit(0)).otherwise(F.unix_seconds(at) + 3600)
            .alias("last_claimed_reward_time"),
            F.when(F.col("priority") == 1, day).otherwise(F.lit(0))
            .alias("last_claimed_premium_reward_day"),
            F.when((F.col("priority") == 5) & (status == "F"), day)
            .when(F.col("priority") != 4, F.lit(0)).alias("last_claimed_ad_reward_day"),
        )

    def user_items(self) -> DataFrame:
        tax = F.rint(F.col("l_tax") * 100)
        lines = self.owned_lines(
            item_definition_excel_id=F.col("l_partkey"),
            # whole numbers: their sums, and so their means, do not depend on the order of the rows
            c_base_critical_chance=F.nullif(F.rint(F.col("l_discount") * 100), F.lit(0.0)),
            c_base_attack_enhanced=F.floor(F.col("l_extendedprice")),
            c_base_defense_enhanced=_null_when(F.col("l_linenumber") == 7, F.col("l_quantity") * 1900),
            enhance_level=F.when(F.col("l_quantity") == 50, tax).otherwise(F.least(tax, F.lit(2.0))).cast("int"),
            created_at=F.col("at"),
        )
        return lines.select(
            export_id(F.col("o_custkey")).alias("user_id"), "item_definition_excel_id", "c_base_critical_chance",
            "c_base_attack_enhanced", "c_base_defense_enhanced", "enhance_level",
            F.lit(0).alias("tempering_level"), F.lit(8).alias("max_enhance_level"),
            "created_at", F.col("created_at").alias("updated_at"),
        )

    def user_items_collection(self) -> DataFrame:
        lines = self.owned_lines(
            item_definition_excel_id=F.col("l_partkey"),
            created_at=_null_when(F.col("l_quantity") == 13, F.col("at")), updated_at=F.col("at"),
        )
        return lines.select(
            export_id(F.col("o_custkey")).alias("user_id"), "item_definition_excel_id", "created_at", "updated_at",
        )

    def support_feedback(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            export_id(F.col("user_id")).alias("user_id"),
            F.when(kind == "view", "VERY_FUN").when(kind == "click", "DONT_LIKE")
            .when(kind == "error", "CRASHES").when(kind == "purchase", "PAY_TO_WIN")
            .otherwise("SOMETHING_ELSE").alias("feedback_type"),
            _days(F.col("ts"), -FEEDBACK_SHIFT_DAYS).alias("created_at"),
        )

    def currency_transactions(self) -> DataFrame:
        """Some players' rows lie before, on and after the edges of the window, some belong to nobody."""
        user, value = F.col("user_id"), F.col("value")
        at = _days(F.col("ts"), -LOG_SHIFT_DAYS)
        at = (
            F.when(user % 7 == 3, _days(at, -29)).when(user % 7 == 5, _days(at, 2))
            .when(user % 7 == 1, F.date_trunc("day", at)).otherwise(at)
        )
        owner = F.when(user % 11 == 7, user + FOREIGN_IDS).otherwise(user)
        bucket = F.floor(F.get_json_object("props", "$.k").cast("int") / 25)
        spent = F.when(user % 3 == 0, 0.0).when(user % 3 == 1, 10.0).otherwise(50.0)
        return self.table("events").select(
            export_id(owner).alias("user_id"),
            _null_when((F.col("event_type") == "error") & (user % 10 == 4), F.col("event_type"))
            .alias("concept"),
            F.concat(F.lit("coin-"), bucket.cast("string")).alias("currency"),
            (value - spent).alias("quantity"), at.alias("created_at"),
        )

    def fights_log(self) -> DataFrame:
        kind = F.col("l_returnflag")
        at = _hours(F.col("l_shipdate"), F.col("l_linenumber"))
        return self.table("lineitem").select(
            export_id(F.col("l_orderkey")).alias("player_id"),
            F.when(kind == "R", "FIGHT_TYPE_ARENA").when(kind == "A", "FIGHT_TYPE_DUNGEON")
            .otherwise("FIGHT_TYPE_TOWER").alias("fight_type"),
            _null_when(
                F.col("l_linenumber") == 7,
                F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0),
            ).alias("fight_winner"),
            F.unix_seconds(at).alias("start_time"),
        )

    def arena_log(self) -> DataFrame:
        at = _hours(F.col("l_shipdate"), F.col("l_linenumber"))
        return self.table("lineitem").where(F.col("l_returnflag") == "R").select(
            export_id(F.col("l_orderkey")).alias("attacker_id"),
            F.unix_seconds(at).alias("time_attacked"),
        )

    def exports(self) -> Mapping[str, DataFrame]:
        return _Exports(self)

    # Score tables: a fixed arithmetic of the keys, so that every branch of the rules occurs.

    def live_scores(self) -> DataFrame:
        """user_id, churn_prob_7d/14d/30d, source."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            plain_id(key).alias("user_id"),
            *[
                (((key * mul + add) % 1009) / 1008.0).alias(f"churn_prob_{h}")
                for h, mul, add in (("7d", 37, 11), ("14d", 53, 5), ("30d", 71, 0))
            ],
            F.lit("live_model").alias("source"),
        )

    def stored_scores(self) -> DataFrame:
        """Saved out-of-fold scores of two thirds of the players, some near the live ones."""
        key = F.col("c_custkey")
        cols = []
        for h, mul, add in (("7d", 37, 11), ("14d", 53, 5), ("30d", 71, 0)):
            live = ((key * mul + add) % 1009) / 1008.0
            moved = live + F.when(key % 7 < 4, 0.03125).otherwise(-0.34375)
            cols.append(
                F.when(moved < 0, 0.0).when(moved > 1, 1.0).otherwise(moved).alias(f"p_churn_{h}")
            )
        return self.table("customer").where(key % 3 != 0).select(
            plain_id(key).alias("user_id"), *cols, F.lit("train").alias("split"),
        )

    def archetypes(self) -> DataFrame:
        """user_id, archetype_n1; some players have none."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            plain_id(key).alias("user_id"),
            _null_when(key % 41 == 0, ((key * 7) % 6).cast("int")).alias("archetype_n1"),
        )
