"""The read API over a data folder: every method gives a lazy DataFrame; parameters are columns, never SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.functions import cleaning as X
from talus.operators import rollups as R
from talus.operators.audit import BOILERPLATE
from talus.plans.audit_queries import _variance, budgets
from talus.plans.ledger_queries import _unattributed
from talus.plans.scored_queries import one_verdict, scored
from talus.sources.ledger import ledger
from talus.sources.sinks import exists, load_together
from talus.tables import name_key, table

VERDICTS = ("genuinely_anomalous", "benign", "needs_review", "insufficient_information")
UNREVIEWED = "screened_unreviewed"
VERDICT_TABLE = "vendor_verdicts.parquet"


class ReadOnlyError(RuntimeError):
    """A write was asked of a read-only API."""


def clamp(n: int, most: int, least: int = 1) -> int:
    return max(least, min(int(n), most))


def holds(column: str, text: str) -> Column:
    """The column contains the text, whatever the case; wildcards have no meaning."""
    return F.upper(F.col(column)).contains(text.upper())


class LedgerApi:
    """Reads of one data folder.  Text never reaches SQL; limits and metrics are checked before anything runs."""

    AGENCY_METRICS = ("hv_txn", "hv_exposure", "n_tier1", "n_tier2", "usd_tier1", "usd_tier2", "tier12_pct", "max_risk_score")
    VENDOR_METRICS = ("usd_tier1", "n_tier1", "n_flagged", "flagged_exposure", "hv_exposure", "max_risk_score")
    PROGRAM_METRICS = ("hv_txn", "hv_exposure", "n_tier1", "usd_tier1", "n_agencies")
    AUDIT_METRICS = ("n_reports", "n_followup", "pages")

    def __init__(self, spark: SparkSession, folder: str, writable: str | None = None):
        self.spark, self.folder, self.writable = spark, folder, writable

    #: Tables without which no read makes sense.
    NEEDED = ("transactions", "tx_tiered", "tier_entities")

    @classmethod
    def opened(cls, spark: SparkSession, folder: str, writable: str | None = None) -> "LedgerApi":
        """The API over a folder that has been found to hold the needed tables."""
        lost = [n for n in cls.NEEDED if not exists(spark, f"{folder}/{n}.parquet")]
        if lost:
            raise FileNotFoundError(f"{folder} has no {', '.join(lost)}")
        return cls(spark, folder, writable)

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _metric(self, metric: str, allowed: tuple[str, ...]) -> str:
        if metric not in allowed:
            raise ValueError(f"metric is one of {', '.join(allowed)}")
        return metric

    # entities and payments
    def entity(self, name: str) -> DataFrame:
        """The entity of a key or name: equal keys first, then names that contain it, the largest first."""
        key = X.normalize_entity_key(name)
        rows = self._table("tier_entities").where((F.col("entity_key") == key) | holds("entity_name", name))
        return rows.orderBy(F.desc(F.col("entity_key") == key), F.desc_nulls_last("usd_tier1"), "entity_key").limit(1)

    def entity_transactions(self, key: str, limit: int = 30, expand_children: bool = False) -> DataFrame:
        """Payments of tiers 1 and 2 under a key, or under all keys that the crosswalk gives it as parent."""
        rows = scored(self.spark, self.folder).where("tier <= 2")
        if expand_children:
            children = self.crosswalk(key).select("entity_key").unionByName(self.spark.createDataFrame([(key,)], "entity_key string")).distinct()
            rows = rows.join(children, "entity_key", "left_semi")
        else:
            rows = rows.where(F.col("entity_key") == key)
        return rows.orderBy(F.desc_nulls_last("risk_score"), F.desc("amount"), "transaction_id").limit(clamp(limit, 200))

    def crosswalk(self, parent: str) -> DataFrame:
        return self._table("entity_crosswalk").where((F.col("parent_key") == parent) & (F.col("entity_key") != parent)).distinct()

    def leads(self, tier: int = 1, status: str | None = None, agency: str | None = None, min_amount: float = 0, limit: int = 50) -> DataFrame:
        rows = scored(self.spark, self.folder).join(one_verdict(self._verdicts()), "entity_key", "left").withColumn("status", F.coalesce("verdict", F.lit(UNREVIEWED)))
        keep = (F.col("tier") == tier) & (F.col("amount") >= min_amount)
        if status:
            keep = keep & (F.col("status") == status)
        if agency:
            keep = keep & (F.col("agency") == agency)
        return rows.where(keep).orderBy(F.desc_nulls_last("risk_score"), F.desc("amount"), "transaction_id").limit(clamp(limit, 200)).select("transaction_id", "fiscal_year", "agency", "payee", "amount", "risk_score", "fired_markers", "status")

    def explain(self, transaction_id: str) -> DataFrame:
        """A payment's families that fired, its multiplier and how the score comes about."""
        rows = scored(self.spark, self.folder).where(F.col("transaction_id") == transaction_id)
        names = [c for c in rows.columns if c.startswith("f_")]
        families = F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c[2:]), F.col(c))]), lambda k, v: v > 0)
        return rows.select("transaction_id", "amount", "tier", families.alias("families"), "fired_markers", F.format_string("%d x %.2f = %.3f", "marker_sum", "category_multiplier", "risk_score").alias("calculation"))

    def search(self, text: str, limit: int = 20) -> DataFrame:
        """Entities, agencies and programs whose names contain the text."""
        e = self._table("tier_entities").where(holds("entity_name", text) | F.upper(F.array_join("agencies", " ")).contains(text.upper())).select(F.lit("entity").alias("kind"), F.col("entity_key").alias("name"), F.col("hv_exposure").alias("usd"))
        x = scored(self.spark, self.folder)
        sums = lambda kind, c: x.where(holds(c, text)).groupBy(F.col(c).alias("name")).agg(F.sum("amount").cast("double").alias("usd")).select(F.lit(kind).alias("kind"), "name", "usd")
        return e.unionByName(sums("agency", "agency")).unionByName(sums("program", "appropriation_1_name")).orderBy("kind", F.desc_nulls_last("usd"), "name").limit(clamp(limit, 100))

    def waterfall(self) -> DataFrame:
        return R.waterfall(scored(self.spark, self.folder))

    # agencies
    def resolve_agency(self, name: str) -> DataFrame:
        """(agency, score, strength): listed agencies that share words with the name, best first; a part of a name scores 0.5 only where no word is shared."""
        form = X.agency_form(F.lit(name))
        words = lambda c: F.filter(F.split(X.sorted_word_key(c, BOILERPLATE), " "), lambda w: w != "")
        rows = self._table("agency_list").select(F.col("agency_name").alias("agency"), words(F.col("agency_name")).alias("b"), X.agency_form(F.col("agency_name")).alias("f"))
        q = words(F.lit(name))
        common = F.size(F.array_intersect(q, F.col("b")))
        base = common / F.nullif(F.least(F.size(q), F.size("b")), F.lit(0)) + F.when((common == F.size(q)) & (common > 0), 0.25).otherwise(0.0)
        score = F.when(F.col("f") == form, 2.0).when(common > 0, base).when(F.col("f").contains(form), 0.5).otherwise(0.0)
        rows = rows.withColumn("score", F.round(score, 4)).where("score > 0")
        strength = F.when(F.col("score") == 2.0, "exact").when(F.col("score") >= 0.75, "strong").otherwise("weak")
        return rows.select("agency", "score", strength.alias("strength")).orderBy(F.desc("score"), F.length("agency"), "agency")

    def agency_card(self, agency: str) -> DataFrame:
        """Scorecard, trend by year, first five vendors and audits of an agency as one row of structs."""
        x = scored(self.spark, self.folder).where(F.col("agency") == agency)
        trend = R.agency_year(x).select(F.lit(agency).alias("agency"), F.struct("fiscal_year", "hv_txn", "hv_exposure", "n_tier1").alias("y")).groupBy("agency").agg(F.sort_array(F.collect_list("y")).alias("trend"))
        top = x.where("entity_key is not null").groupBy("entity_key").agg(F.sum("amount").cast("double").alias("usd")).orderBy(F.desc("usd"), "entity_key").limit(5).agg(F.collect_list(F.struct("usd", "entity_key")).alias("v")).select(F.lit(agency).alias("agency"), F.sort_array("v", asc=False).alias("top_vendors"))
        audits = self._table("ag_reports").where(F.col("agency_checkbook") == agency).agg(F.count(F.lit(1)).alias("n_reports"), F.max("fiscal_year").alias("last_report_fy")).withColumn("agency", F.lit(agency))
        return R.agency_scorecard(x).join(trend, "agency", "left").join(top, "agency", "left").join(audits, "agency", "left")

    def rank_agencies(self, metric: str = "usd_tier1", limit: int = 20) -> DataFrame:
        m = self._metric(metric, self.AGENCY_METRICS)
        return R.agency_scorecard(scored(self.spark, self.folder)).orderBy(F.desc_nulls_last(m), "agency").limit(clamp(limit, 100)).select("agency", m)

    def rank_vendors(self, metric: str = "usd_tier1", agency: str | None = None, limit: int = 20) -> DataFrame:
        m, rows = self._metric(metric, self.VENDOR_METRICS), self._table("tier_entities")
        if agency:
            rows = rows.where(F.upper(F.array_join("agencies", " ")).contains(agency.upper()))
        return rows.orderBy(F.desc_nulls_last(m), "entity_key").limit(clamp(limit, 100)).select("entity_key", m)

    def rank_programs(self, metric: str = "usd_tier1", limit: int = 20) -> DataFrame:
        m = self._metric(metric, self.PROGRAM_METRICS)
        return R.program_summary(scored(self.spark, self.folder)).orderBy(F.desc_nulls_last(m), "program").limit(clamp(limit, 100))

    # spending
    def spend(self, agency: str | None = None, fiscal_year: int | None = None, category: str | None = None, transaction_type: str = "EX", breakdown: str | None = None, limit: int = 25) -> DataFrame:
        """Spending in total or by category, year or vendor; the keyword is looked for in four columns."""
        by = {"category": "category2", "year": "fiscal_year", "vendor": "payee"}
        if breakdown not in (None, *by):
            raise ValueError(f"breakdown is one of {', '.join(by)}")
        keep = F.col("kind") == transaction_type
        if agency:
            keep = keep & (F.col("agency") == agency)
        if fiscal_year is not None:
            keep = keep & (F.col("fiscal_year") == fiscal_year)
        if category:
            keep = keep & (holds("category1", category) | holds("category2", category) | holds("category3", category) | holds("appropriation", category))
        rows = ledger(self.spark, self.folder).where(keep)
        if breakdown is None:
            return rows.agg(F.count(F.lit(1)).alias("n_txns"), F.sum("amount").alias("_s")).select("n_txns", R.money("_s", "total_usd"))
        return R.spend_breakdown(rows, by[breakdown], "amount", F.count(F.lit(1))).orderBy(F.desc("total_usd"), F.asc_nulls_last(by[breakdown])).limit(clamp(limit, 200))

    def unattributed(self, agency: str | None = None, limit: int = 25) -> DataFrame:
        """Buckets of hidden payees of an agency, or the agencies with most of them."""
        rows = ledger(self.spark, self.folder)
        if agency:
            return R.total(rows.where((F.col("kind") == "EX") & (F.col("agency") == agency)).withColumn("bucket", X.unattributed_bucket(F.col("payee"))), ["bucket"])
        return _unattributed(rows).orderBy(F.desc("dark_usd"), "agency").limit(clamp(limit, 100))

    def evidence(self, agency: str, limit: int = 6) -> DataFrame:
        """Where an agency's hidden payments lie: categories and funds with the largest sums."""
        rows = ledger(self.spark, self.folder).where((F.col("kind") == "EX") & (F.col("agency") == agency) & (X.unattributed_bucket(F.col("payee")) != "named"))
        part = lambda kind, c: R.total(rows.withColumnRenamed(c, "name"), ["name"]).orderBy(F.desc("total_usd"), F.asc_nulls_last("name")).limit(clamp(limit, 50)).select(F.lit(kind).alias("kind"), "name", "n_txns", "total_usd")
        return part("category", "category1").unionByName(part("fund", "fund"))

    # audits and budgets
    def audits(self, agency: str) -> DataFrame:
        return self._table("ag_reports").where(F.col("agency_checkbook") == agency).orderBy(F.desc_nulls_last("fiscal_year"), "report_id")

    def search_findings(self, text: str, limit: int = 20) -> DataFrame:
        rows = self._table("ag_reports").where(holds("title", text) | holds("agency_raw", text) | holds("agency_checkbook", text))
        return rows.orderBy(F.desc_nulls_last("fiscal_year"), "report_id").limit(clamp(limit, 100)).select("report_id", "fiscal_year", "title")

    def rank_audits(self, metric: str = "n_reports", limit: int = 20) -> DataFrame:
        m = self._metric(metric, self.AUDIT_METRICS)
        out = self._table("ag_reports").where("agency_checkbook is not null").groupBy("agency_checkbook").agg(F.countDistinct("report_id").alias("n_reports"), F.count(F.when(F.col("report_type") == "followup", 1)).alias("n_followup"), F.sum("total_pages").alias("pages"))
        return out.orderBy(F.desc_nulls_last(m), "agency_checkbook").limit(clamp(limit, 100))

    def finding_transactions(self, report_id: str, keyword: str | None = None, window_years: int = 1, limit: int = 50) -> DataFrame:
        """Scored payments of a report's agency in the years around it, narrowed to funds that contain the keyword."""
        w = clamp(window_years, 3, 0)
        report = self._table("ag_reports").where(F.col("report_id") == report_id).select(F.col("agency_checkbook").alias("agency"), F.explode(F.sequence(F.col("fiscal_year") - w, F.col("fiscal_year") + w)).alias("fiscal_year"))
        rows = scored(self.spark, self.folder).join(report, ["agency", "fiscal_year"])
        if keyword:
            rows = rows.where(holds("fund_1_name", keyword))
        return rows.orderBy(F.desc_nulls_last("risk_score"), F.desc("amount"), "transaction_id").limit(clamp(limit, 200))

    def triangulation(self) -> DataFrame:
        return _variance(self.spark, self.folder)

    def budget(self, limit: int = 25) -> DataFrame:
        return budgets(self.spark, self.folder).orderBy(F.desc("budget"), "agency_form").limit(clamp(limit, 200))

    # verdicts
    def verdicts_pending(self, tier: int = 1, limit: int = 50) -> DataFrame:
        """Entities with payments of a tier and no verdict, also where a verdict row has none."""
        rows = self._table("tier_entities").where(F.col(f"n_tier{clamp(tier, 2)}") > 0).withColumn("k", X.entity_key(F.col("entity_key")))
        known = one_verdict(self._verdicts()).select(F.col("entity_key").alias("k"), "verdict")
        return rows.join(known, "k", "left").where("verdict is null").orderBy(F.desc_nulls_last("usd_tier1"), "entity_key").limit(clamp(limit, 200)).drop("k", "verdict")

    def set_verdict(self, key: str, verdict: str, interest: int = 0, context: str | None = None) -> DataFrame:
        """The verdicts with one more, or in place of all rows of the same name key however spelt, written below the writable folder.

        Later calls and reads of this API go on from there.  The table is replaced
        whole, and a failure leaves the one before.
        """
        if self.writable is None:
            raise ReadOnlyError("this API was opened without a folder to write to")
        if verdict not in VERDICTS:
            raise ValueError(f"a verdict is one of {', '.join(VERDICTS)}")
        old, name = self._verdicts(), X.normalize_entity_key(key)
        new = self.spark.createDataFrame([(name, verdict, interest, context)], "entity_key string, verdict string, overtaker_interest int, public_context string")
        new = new.withColumn("recommended_action", F.lit(None).cast("string")).withColumn("reviewed_at", F.current_timestamp().cast(old.schema["reviewed_at"].dataType))
        kept = old.where(F.coalesce(name_key(F.col("entity_key")) != name, F.lit(True)))
        load_together(self.spark, {VERDICT_TABLE: kept.unionByName(new.select(*old.columns))}, self.writable)
        return self._verdicts()

    def _verdicts(self) -> DataFrame:
        """The verdict rows: those below the writable folder once there are any, else those of the data folder."""
        own = self.writable is not None and exists(self.spark, f"{self.writable}/{VERDICT_TABLE}")
        return self.spark.read.parquet(f"{self.writable}/{VERDICT_TABLE}") if own else self._table("vendor_verdicts")

    def with_verdicts(self) -> DataFrame:
        """The scored payments with the status that travels with each."""
        rows = scored(self.spark, self.folder).join(one_verdict(self._verdicts()), "entity_key", "left")
        return rows.withColumn("status", F.coalesce("verdict", F.lit(UNREVIEWED))).drop("verdict", "interest")


def tools(api: LedgerApi) -> dict[str, Callable[..., DataFrame]]:
    """The read methods by name, for command line, server and question loop alike."""
    names = "entity entity_transactions crosswalk leads explain search waterfall resolve_agency agency_card rank_agencies rank_vendors rank_programs spend unattributed evidence audits search_findings rank_audits finding_transactions triangulation budget verdicts_pending"
    return {n: getattr(api, n) for n in names.split()}
