"""Every operator as a query over a folder of Parquet tables (see ``sources.retail``)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.context import RunContext
from tidemark.functions import diversity, ids
from tidemark.operators import cleanup, clusters, report
from tidemark.operators.archetypes import CentroidArchetypes
from tidemark.operators.block import CHURN
from tidemark.operators.characters import character_owners
from tidemark.operators.encode import fit_encoder
from tidemark.operators.evaluate import evaluate_each
from tidemark.operators.logs import log_window
from tidemark.operators.models import (
    evaluate_splits, fit_archetypes, fit_churn, fold_encoders, fold_frame, fold_of, out_of_fold, scattered,
)
from tidemark.operators.reconcile import reconcile
from tidemark.operators.sample import (
    churn_labels, derive_sample, in_sample, last_login_day, run_context,
)
from tidemark.operators.segment import (
    archetype_name, cross, crossed_predictions, priority, risk_level, segmentation,
)
from tidemark.operators.split import stratified_split
from tidemark.operators.taste import (
    RECENT_FEATURES, UNIVERSAL_FEATURES, assign_actions, taste_axes, taste_profile,
)
from tidemark.operators.thresholds import fit_level, fit_taste
from tidemark.plans import master as plans
from tidemark.plans.score import run_metadata
from tidemark.rule_document import packaged_rules
from tidemark.rules import ARCHETYPE_FEATURES, ENCODED_COLUMNS, HORIZONS, TARGETS, RuleBook
from tidemark.sources.canonical import Tables
from tidemark.sources.identify import identify, table_headers, validation_report
from tidemark.sources.readers import oof_scores
from tidemark.sources.retail import Retail, export_id
from tidemark.sources.staging import stage, staging_path
from tidemark.sources.subset import subset
from tidemark.streaming.counter_table import CounterTable
from tidemark.streaming.daily_counts import (
    features_from_counters, fights_from_counters, read_log_stream, run_counters, run_fights,
)

SUBSET_USERS = 100
TOP_PLAYERS = 20
STREAM_BATCHES = 5
# Days of fights that are kept: shipments go on for four months after the reference day.
FIGHT_DAYS = 180


class Inputs:
    """What the queries share: prepared tables, the time frame, the sample."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.rules = spark, RuleBook()
        self.retail = Retail(spark, folder)

    @cached_property
    def raw(self) -> Mapping[str, DataFrame]:
        return self.retail.exports()

    @cached_property
    def tables(self) -> Tables:
        return Tables(self.spark, self.raw)

    @cached_property
    def ctx(self) -> RunContext:
        return run_context(self.retail.last_logins())

    @cached_property
    def sample(self) -> DataFrame:
        return derive_sample(self.tables.users, self.ctx)

    @cached_property
    def master(self) -> DataFrame:
        return plans.taste_master(self.tables, self.ctx, rules=self.rules)

    @cached_property
    def taste_features(self) -> DataFrame:
        """The master reduced to the blocks the axes read."""
        wanted = (*UNIVERSAL_FEATURES, *RECENT_FEATURES)
        return plans.taste_master(self.tables, self.ctx, rules=self.rules, wanted=wanted)

    @cached_property
    def archetypes(self) -> DataFrame:
        return self.retail.archetypes()

    @cached_property
    def live(self) -> DataFrame:
        return self.retail.live_scores()

    @cached_property
    def scores(self) -> DataFrame:
        stored = oof_scores(self.spark, self.retail.stored_scores())
        return reconcile(self.live, stored, self.rules.drift_threshold)

    @cached_property
    def profile(self) -> DataFrame:
        return taste_profile(self.taste_features, self.archetypes, self.rules)

    @cached_property
    def predictions(self) -> DataFrame:
        return report.full_predictions(self.scores, self.archetypes, self.profile, self.rules)

    @cached_property
    def scored_archetypes(self) -> DataFrame:
        """Predictions without the taste part, for reports that do not read it."""
        blank = report.without_archetypes(self.scores).drop("archetype_n1", "archetype_name")
        return blank.join(self.archetypes, "user_id", "left").withColumn(
            "archetype_name", archetype_name(F.col("archetype_n1"), self.rules)
        )

    def features(self, block: str, part=CHURN) -> DataFrame:
        return plans.features(block, self.sample, self.tables, self.ctx, self.rules, part)

    def labels(self) -> DataFrame:
        return churn_labels(self.tables.users, self.ctx)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, so that two engines can be compared; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


# --- sources --------------------------------------------------------------------------------------


def id_normalize(i: Inputs) -> DataFrame:
    key = F.col("c_custkey")
    raw = (
        F.when(key % 5 == 4, F.concat(F.lit("guest-"), key.cast("string")))
        .when(key % 7 == 6, F.concat(F.lit("id="), export_id(key), F.lit(";")))
        .otherwise(export_id(key))
    )
    return i.retail.table("customer").select(
        key, F.when(key % 11 != 10, raw).alias("raw")
    ).select(
        "c_custkey", ids.wrapped_or_raw(F.col("raw")).alias("id_raw"),
        ids.wrapped_or_strict(F.col("raw")).alias("id_strict"),
        ids.first_hex_run(F.col("raw")).alias("id_hex"),
    )


def scan_semi_sample(i: Inputs) -> DataFrame:
    chosen = i.tables.users.where(F.col("gold") >= 0)
    kept = in_sample(i.tables.user_items, chosen)
    return kept.select(
        "user_id", "item_definition_excel_id", "c_base_attack_enhanced", "enhance_level",
        F.unix_micros("created_at").alias("created_us"),
    )


def log_window_scan(i: Inputs) -> DataFrame:
    rows = log_window(i.tables.currency_transactions, i.ctx, "created_at")
    return in_sample(rows, i.sample).select(
        "user_id", "concept", "currency", "quantity", F.unix_micros("created_at").alias("created_us")
    )


def _row_counts(i: Inputs, names) -> DataFrame:
    out = None
    for name in names:
        one = i.raw[name].agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("file"), "n_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


def schema_match(i: Inputs) -> DataFrame:
    found = identify(table_headers(i.spark, i.raw))
    return found.join(_row_counts(i, i.raw), "file")


def schema_report(i: Inputs) -> DataFrame:
    """A directory without devices, whose items lack their enhance level."""
    files = {n: df for n, df in i.raw.items() if n != "devices"}
    files["user_items"] = files["user_items"].drop("enhance_level")
    found = validation_report(table_headers(i.spark, files))
    return found.join(_row_counts(i, files), "file", "left")


def referential_subset(i: Inputs) -> DataFrame:
    parts = subset(i.raw, SUBSET_USERS)
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


# --- sample and features ---------------------------------------------------------------------------


def stat(name: str) -> Callable[[Inputs], DataFrame]:
    dims = {"binge": ["day"]}.get(name, ["event_type"])

    def query(i: Inputs) -> DataFrame:
        events = i.retail.table("events").withColumn("day", F.to_date("ts"))
        counts = events.groupBy("user_id", *dims).agg(F.count(F.lit(1)).alias("n"))
        column = {"binge": "burst"}.get(name, name)
        return diversity.count_statistics(counts, ["user_id"]).select(
            "user_id", F.col(column).alias(name)
        )

    return query


def threshold_fit(i: Inputs) -> DataFrame:
    fitted = fit_taste(i.taste_features) | fit_level(i.tables.characters, i.sample)
    rows = [(k, v) for k, v in fitted.items()]
    return i.spark.createDataFrame(rows, "threshold string, value double")


def _labelled(i: Inputs) -> DataFrame:
    users = i.features("users").select(
        "user_id", "country", "has_user_rated_app", "user_store_where_published"
    )
    devices = i.features("devices").select("user_id", "device_primary_platform")
    return users.join(devices, "user_id").join(i.labels(), "user_id").where(
        F.col("churn_7d").isNotNull()
    )


def _encoder(i: Inputs):
    rows = stage(_labelled(i), "labelled")
    for t in TARGETS:
        rows = stratified_split(rows, t).withColumnRenamed("split", f"split_{t}")
    return rows, fit_encoder(rows, TARGETS, ENCODED_COLUMNS, {t: f"split_{t}" for t in TARGETS})


def target_encode_fit(i: Inputs) -> DataFrame:
    return _encoder(i)[1].mappings


def target_encode_apply(i: Inputs) -> DataFrame:
    rows, encoder = _encoder(i)
    encoder.mappings = stage(encoder.mappings, "encoder")
    return encoder.apply(rows.select("user_id", *ENCODED_COLUMNS), ["churn_30d"], in_place=True)


def stratified(i: Inputs) -> DataFrame:
    labels = i.labels().where(F.col("churn_30d").isNotNull()).select("user_id", "churn_30d")
    return stratified_split(labels, "churn_30d")


# --- clean-up ---------------------------------------------------------------------------------------


def _staged_master(i: Inputs) -> DataFrame:
    return stage(plans.churn_master(i.tables, i.ctx, rules=i.rules), "master")


def cleanup_high_null(i: Inputs) -> DataFrame:
    shares = cleanup.null_shares(plans.churn_master(i.tables, i.ctx, rules=i.rules))
    return shares.withColumn("dropped", F.col("null_share") > 0.95)


def cleanup_quasi_constant(i: Inputs) -> DataFrame:
    df = _staged_master(i)
    return cleanup.majority_shares(df, [c for c in df.columns if c != "user_id"], 0.95)


def cleanup_corr_pairs(i: Inputs) -> DataFrame:
    df = _staged_master(i)
    pairs = cleanup.correlations(df, cleanup.numeric_columns(df, ["user_id"]))
    return pairs.where(F.abs("corr") >= 0.95)


def cleanup_report(i: Inputs) -> DataFrame:
    return cleanup.plan_cleanup(_staged_master(i)).report(i.spark)


def cleanup_apply(i: Inputs) -> DataFrame:
    df = _staged_master(i)
    out = None
    for name, kept in cleanup.apply_cleanup(df, cleanup.plan_cleanup(df)).items():
        one = kept.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("variant"), F.lit(len(kept.columns)).alias("n_columns"), "n_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


# --- models -----------------------------------------------------------------------------------------


def eval_metrics(i: Inputs) -> DataFrame:
    both = i.live.join(i.labels(), "user_id")
    return evaluate_each(both, {t: (f"churn_prob_{days}d", t) for t, days in HORIZONS.items()})


def fitted(i: Inputs, targets=TARGETS, calibrate=False):
    labels = i.labels().where(F.col("churn_7d").isNotNull())
    master = stage(plans.churn_master(i.tables, i.ctx, rules=i.rules), "master")
    models, rows = fit_churn(master, labels, "check", targets, calibrate=calibrate)
    return master, models, rows


def churn_score(i: Inputs) -> DataFrame:
    master, models, _ = fitted(i, calibrate=True)
    return models.score(scattered(master))


def churn_fit_eval(i: Inputs) -> DataFrame:
    _, models, rows = fitted(i)
    return evaluate_splits(models, rows)


def feature_importance(i: Inputs) -> DataFrame:
    _, models, _ = fitted(i)
    out = None
    for t in TARGETS:
        one = models.importances(i.spark, t).withColumn("target", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def oof_predictions(i: Inputs) -> DataFrame:
    """Out-of-fold scores of all three horizons."""
    labels = i.labels().where(F.coalesce(*TARGETS).isNotNull())
    master = plans.churn_master(i.tables, i.ctx, rules=i.rules)
    return out_of_fold(master.join(labels, "user_id"), TARGETS)


def oof_folds(i: Inputs) -> DataFrame:
    """The fold of every labelled player and horizon, and the encodings' support outside it."""
    labels = i.labels()
    return fold_frame(labels, TARGETS)


def oof_encodings(i: Inputs) -> DataFrame:
    """Encodings of the categories of all horizons and folds, without the fold's own players."""
    rows = stage(_labelled(i).withColumn("fold", fold_of(F.col("user_id"))), "labelled")
    return fold_encoders(rows, TARGETS, ENCODED_COLUMNS)[0]


def churn_splits(i: Inputs) -> DataFrame:
    """Rows and positives of every horizon's parts."""
    rows = stage(i.labels().where(F.col("churn_7d").isNotNull()), "labels")
    out = None
    for t in TARGETS:
        one = stratified_split(rows.select("user_id", t), t).groupBy("split").agg(
            F.count(F.lit(1)).alias("n"), F.sum(t).alias("positives")
        ).select(F.lit(t).alias("target"), "split", "n", "positives")
        out = one if out is None else out.unionByName(one)
    return out


def archetype_assign(i: Inputs) -> DataFrame:
    """Archetypes by the centroids of a model document."""
    model = CentroidArchetypes.packaged("given_archetypes.json")
    return model.assign(plans.taste_master(i.tables, i.ctx, rules=i.rules, wanted=tuple(model.features)))


def archetype_fit(i: Inputs) -> DataFrame:
    # Only the model's columns are written, so the optimizer leaves out what none of them needs.
    master = stage(i.master.select("user_id", *ARCHETYPE_FEATURES), "master")
    return fit_archetypes(master, "check").assign(master)


def nearest_centroid(i: Inputs) -> DataFrame:
    vectors = i.retail.table("embeddings")
    centroids = clusters.mean_centroids(vectors, "embedding", "label")
    return clusters.nearest_centroid(vectors, "embedding", centroids, "code").select(
        "vec_id", "label", "code", "distance"
    )


def cluster_quality(i: Inputs) -> DataFrame:
    return clusters.cluster_quality(i.retail.table("embeddings"), "embedding", "label")


# --- segmentation and taste ---------------------------------------------------------------------------


def _crossed(i: Inputs) -> DataFrame:
    return cross(i.live, i.archetypes.where(F.col("archetype_n1").isNotNull()), i.rules)


def risk_levels(i: Inputs) -> DataFrame:
    return i.live.select(
        "user_id", *[
            risk_level(F.col(f"churn_prob_{h}"), i.rules).alias(f"risk_{h}")
            for h in ("7d", "14d", "30d")
        ]
    )


def priority_rules(i: Inputs) -> DataFrame:
    both = i.live.join(i.archetypes, "user_id")
    ruled = priority(
        risk_level(F.col("churn_prob_30d"), i.rules), F.col("archetype_n1"), i.rules
    )
    return both.select("user_id", "archetype_n1", ruled.alias("r")).select(
        "user_id", "archetype_n1", "r.priority", "r.label"
    )


def document_rules(i: Inputs) -> DataFrame:
    """Risk, priority, drift and action under the rules of a document."""
    book = packaged_rules("strict_rules.json")
    stored = oof_scores(i.spark, i.retail.stored_scores())
    scores = reconcile(i.live, stored, book.drift_threshold).select("user_id", "churn_30d_source", "churn_30d_final")
    actions = taste_profile(i.taste_features, i.archetypes, book).select("user_id", "contramedida_primaria_cod", "contramedida_primaria_label")
    risk = risk_level(F.col("churn_30d_final"), book)
    both = scores.join(i.archetypes, "user_id").join(actions, "user_id", "left")
    ruled = both.withColumn("risk", risk).withColumn("r", priority(F.col("risk"), F.col("archetype_n1"), book))
    return ruled.select(
        "user_id", "churn_30d_source", "risk", "r.priority", "r.label",
        (F.col("churn_30d_final") >= book.high_risk).cast("int").alias("at_risk"),
        "contramedida_primaria_cod", "contramedida_primaria_label",
    )


def taste_axes_query(i: Inputs) -> DataFrame:
    return taste_axes(i.taste_features, i.archetypes, i.rules)


def countermeasure_assign(i: Inputs) -> DataFrame:
    axes = taste_axes(i.taste_features, i.archetypes, i.rules)
    return assign_actions(axes, i.rules).select(
        "user_id", "contramedida_primaria_cod", "contramedida_primaria_label"
    )


# --- streaming --------------------------------------------------------------------------------------


def _arrivals(i: Inputs, name: str, table: str, label: str, arrival: Column) -> DataFrame:
    """The export of a log as a stream of several micro-batches, in another order than its times.

    The source rows are laid out in folders by ``arrival``, without a shuffle, and a batch takes a share of
    the files, so every batch has rows of days that earlier batches had already counted.
    """
    path = staging_path(i.spark, label)
    source = i.retail.table(table)
    source.withColumn("arrival", arrival).write.partitionBy("arrival").parquet(path)
    files = len(i.spark.read.schema(source.schema).parquet(path).inputFiles())
    stream = read_log_stream(i.spark, path, source.schema, files_per_batch=-(-files // STREAM_BATCHES) or 1)

    class Streamed(Retail):
        def table(self, name: str) -> DataFrame:
            return stream

    return getattr(Streamed(i.spark, i.retail.folder), name)()


def _stream_counters(i: Inputs) -> CounterTable:
    """The event stream as a currency log, folded by the streaming counters."""
    return run_counters(i.spark, _arrivals(i, "currency_transactions", "events", "events", F.hour("ts") % STREAM_BATCHES), "counters")


def stream_daily_counts(i: Inputs) -> DataFrame:
    return _stream_counters(i).read().drop("midnight_n", "midnight_n_in", "midnight_n_out")


def stream_currency_features(i: Inputs) -> DataFrame:
    return in_sample(features_from_counters(_stream_counters(i), i.ctx), i.sample)


def stream_fight_features(i: Inputs) -> DataFrame:
    """Fights in several batches; two thirds of the characters are known while they arrive."""
    raw = _arrivals(i, "fights_log", "lineitem", "fights", F.col("l_linenumber") % STREAM_BATCHES)
    owners = character_owners(i.tables.characters)
    early = owners.where(F.pmod(F.xxhash64("char_id"), F.lit(3)) > 0)
    return fights_from_counters(run_fights(i.spark, raw, early, "fights", FIGHT_DAYS), owners, i.ctx)


QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    "id_normalize": id_normalize,
    "scan_semi_sample": scan_semi_sample,
    "log_window_scan": log_window_scan,
    "schema_match": schema_match,
    "schema_report": schema_report,
    "referential_subset": referential_subset,
    "reference_date": lambda i: last_login_day(i.tables.users),
    "sample_derive": lambda i: i.sample,
    "feat_users": lambda i: i.features("users"),
    "feat_characters": lambda i: i.features("characters"),
    "feat_devices": lambda i: i.features("devices"),
    "feat_iaps": lambda i: i.features("purchases"),
    "feat_rewards": lambda i: i.features("rewards"),
    "feat_items": lambda i: i.features("items"),
    "feat_collection": lambda i: i.features("collection"),
    "feat_feedback": lambda i: i.features("feedback"),
    "feat_derived": lambda i: plans.derived_features(i.sample, i.tables, i.ctx, i.rules),
    "feat_currency": lambda i: i.features("currency", plans.TASTE),
    "feat_fights": lambda i: i.features("fights", plans.TASTE),
    "feat_arena": lambda i: i.features("arena", plans.TASTE),
    "master_churn": lambda i: plans.churn_master(i.tables, i.ctx, rules=i.rules),
    "master_taste": lambda i: i.master,
    "stat_entropy": stat("entropy"),
    "stat_gini": stat("gini"),
    "stat_simpson": stat("simpson"),
    "stat_binge": stat("binge"),
    "threshold_fit": threshold_fit,
    "target_encode_fit": target_encode_fit,
    "target_encode_apply": target_encode_apply,
    "stratified_split": stratified,
    "cleanup_high_null": cleanup_high_null,
    "cleanup_quasi_constant": cleanup_quasi_constant,
    "cleanup_corr_pairs": cleanup_corr_pairs,
    "cleanup_report": cleanup_report,
    "cleanup_apply": cleanup_apply,
    "churn_labels": lambda i: i.labels(),
    "eval_metrics": eval_metrics,
    "churn_score": churn_score,
    "churn_fit_eval": churn_fit_eval,
    "feature_importance": feature_importance,
    "oof_predictions": oof_predictions,
    "oof_folds": oof_folds,
    "oof_encodings": oof_encodings,
    "churn_splits": churn_splits,
    "archetype_assign": archetype_assign,
    "archetype_fit": archetype_fit,
    "nearest_centroid": nearest_centroid,
    "cluster_quality": cluster_quality,
    "drift_reconcile": lambda i: i.scores,
    "risk_levels": risk_levels,
    "priority_rules": priority_rules,
    "document_rules": document_rules,
    "cross_predictions": lambda i: crossed_predictions(_crossed(i)),
    "cross_segment": lambda i: segmentation(_crossed(i)),
    "taste_axes": taste_axes_query,
    "taste_profile": lambda i: i.profile,
    "countermeasure_assign": countermeasure_assign,
    "predictions_full": lambda i: i.predictions,
    "predictions_business": lambda i: report.business_predictions(i.predictions),
    "summary_targets": lambda i: report.target_summary(i.scores),
    "summary_distribution": lambda i: report.distribution(i.predictions),
    "report_high_risk": lambda i: report.high_risk(i.scored_archetypes, i.rules),
    "report_kpis": lambda i: report.kpis(i.scored_archetypes, i.rules),
    "report_archetypes": lambda i: report.archetype_table(i.scored_archetypes, i.rules),
    "report_actions": lambda i: report.action_table(i.predictions),
    "report_ranked_players": lambda i: report.ranked_players(i.predictions),
    "report_top_players": lambda i: report.top_players(i.predictions, TOP_PLAYERS),
    "run_metadata": lambda i: run_metadata(i.scored_archetypes, i.ctx, i.rules, TARGETS, "ok"),
    "stream_daily_counts": stream_daily_counts,
    "stream_currency_features": stream_currency_features,
    "stream_fight_features": stream_fight_features,
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return rounded(QUERIES[name](Inputs(spark, folder)))
