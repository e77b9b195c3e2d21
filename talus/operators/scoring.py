"""Scoring of payments by configured markers: families, multiplier, score, band and tier."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions import cleaning as X
from talus.operators.mart import MartConfig, contract_rate, payee_profile, true_duplicates


@dataclass(frozen=True)
class Marker:
    """A rule: its label, its family, its score and its predicate over the mart's columns (SQL that is true, false or null)."""

    label: str
    family: str
    score: int
    predicate: str


@dataclass(frozen=True)
class ScoreConfig:
    """The whole model as data: markers, multipliers and the bounds of bands and tiers."""

    markers: tuple[Marker, ...]
    multipliers: dict[str, Decimal] = field(default_factory=dict)
    # Bounds and names of magnitude classes, bands and tiers.
    least_amount: int = 100_000
    high_amount: int = 1_000_000
    bands: tuple[int, ...] = (0, 3, 6, 10)
    band_names: tuple[str, ...] = ("R0_NONE", "R1_LOW", "R2_MODERATE", "R3_ELEVATED", "R4_HIGH")

    @property
    def families(self) -> list[str]:
        return list(dict.fromkeys(m.family for m in self.markers))


#: A model of our own, an example to be replaced by the user's: what is odd about the amount, its repetition, its share,
#: its time, its distance from peers and its record.  It needs the columns of ``with_history``.
DEFAULT = ScoreConfig(
    markers=(
        Marker("million_multiple", "amount", 2, "is_round_1000000"),
        Marker("whole_amount", "amount", 1, "is_whole_dollar"),
        Marker("paid_again", "repetition", 3, "is_paid_again"),
        Marker("same_reference", "repetition", 2, "in_dup_signature"),
        Marker("half_of_the_year", "share", 3, "vendor_share_of_agency_year >= 0.5"),
        Marker("tenth_of_the_year", "share", 1, "vendor_share_of_agency_year >= 0.1"),
        Marker("after_closing", "time", 2, "fp_canon > 12"),
        Marker("name_is_new", "time", 1, "payee_first_year = fiscal_year"),
        Marker("far_above_peers", "peers", 2, "robust_z_in_agencycat >= 10"),
        Marker("contract_missing", "record", 2, "contract IS NULL AND contract_rate >= 0.5"),
        Marker("payee_missing", "record", 1, "payee IS NULL"),
    ),
)


def with_history(mart: DataFrame, clean: DataFrame, config: MartConfig = MartConfig()) -> DataFrame:
    """The mart with what other payments say of each: ``is_paid_again`` (vendor and amount paid under several references within days),
    ``payee_first_year`` and ``contract_rate`` of the agency's year; false or null where there is nothing.

    Three left joins on group keys, so no payment is lost or doubled.
    """
    again = true_duplicates(clean, config.duplicate_days).select("vid", "amount", F.lit(True).alias("_again"))
    payees = payee_profile(clean).select("entity_key", F.col("first_fy").alias("payee_first_year"))
    rows = mart.withColumn("entity_key", X.entity_key(F.col("payee")))
    rows = rows.join(again, ["vid", "amount"], "left").join(payees, "entity_key", "left").join(contract_rate(clean), ["agency", "fiscal_year"], "left")
    return rows.withColumn("is_paid_again", F.coalesce("_again", F.lit(False))).drop("_again", "entity_key")


def score(mart: DataFrame, config: ScoreConfig = DEFAULT) -> DataFrame:
    """Adds f_<family>, marker_sum, category_multiplier, risk_score, fired_markers, n_markers, mag_class, risk_band and tier.

    A marker whose predicate is null does not fire.  A family counts its highest
    marker once; the score is the families' sum times the multiplier of the
    category, as exact decimals.  Three narrow projections, no shuffle.
    """
    rows = mart.where(F.col("amount") >= config.least_amount)
    hits = {m.label: F.coalesce(F.expr(m.predicate).cast("boolean"), F.lit(False)) for m in config.markers}
    rows = rows.withColumns({f"_m_{label}": hit for label, hit in hits.items()})
    points = lambda m: F.when(F.col(f"_m_{m.label}"), m.score).otherwise(0)
    families = {}
    for f in config.families:
        own = [points(m) for m in config.markers if m.family == f]
        families[f"f_{f}"] = F.greatest(*own) if len(own) > 1 else own[0]
    rows = rows.withColumns(families)
    total: Column = sum((F.col(f) for f in families), F.lit(0))
    factor = F.lit(Decimal("1.0")).cast("decimal(4,2)")
    for category, m in config.multipliers.items():
        factor = F.when(F.col("category1") == category, F.lit(m).cast("decimal(4,2)")).otherwise(factor)
    fired = F.array_compact(F.array(*[F.when(F.col(f"_m_{m.label}"), F.lit(m.label)) for m in config.markers]))
    rows = rows.withColumns({"marker_sum": total, "category_multiplier": factor, "fired_markers": fired})
    rows = rows.withColumn("risk_score", F.round(F.col("marker_sum").cast("decimal(10,0)") * F.col("category_multiplier"), 3))
    s, high = F.col("risk_score"), F.col("amount") >= config.high_amount
    band = F.when(s <= config.bands[0], config.band_names[0])
    for bound, name in zip(config.bands[1:], config.band_names[1:]):
        band = band.when(s < bound, name)
    b1, b2 = config.bands[1], config.bands[2]
    tier = F.when(high & (s >= b2), 1).when(high & (s >= b1) | ~high & (s >= b2), 2).when(s > 0, 3).when(high, 4).otherwise(5)
    rows = rows.withColumns({"n_markers": F.size("fired_markers"), "mag_class": F.when(high, "MB_HIGH").otherwise("MB_LOW"), "risk_band": band.otherwise(config.band_names[-1]), "tier": tier})
    return rows.drop(*[f"_m_{m.label}" for m in config.markers])


def score_sql(mart: str, config: ScoreConfig = DEFAULT) -> str:
    """The same model as one SQL statement over the relation ``mart``."""
    fams = {f: "greatest(" + ", ".join(f"CASE WHEN {m.predicate} THEN {m.score} ELSE 0 END" for m in config.markers if m.family == f) + ", 0)" for f in config.families}
    factor = "CASE " + " ".join(f"WHEN category1 = '{c}' THEN CAST({m} AS DECIMAL(4,2))" for c, m in config.multipliers.items()) + " WHEN true THEN CAST(1.0 AS DECIMAL(4,2)) END"
    fired = "list_filter([" + ", ".join(f"CASE WHEN {m.predicate} THEN '{m.label}' END" for m in config.markers) + "], lambda x: x IS NOT NULL)"
    inner = f"SELECT *, {', '.join(f'{e} AS f_{f}' for f, e in fams.items())}, {factor} AS category_multiplier, {fired} AS fired_markers FROM {mart} WHERE amount >= {config.least_amount}"
    total = " + ".join(f"f_{f}" for f in fams)
    middle = f"SELECT *, {total} AS marker_sum, round(CAST(({total}) * category_multiplier AS DOUBLE), 3) AS risk_score FROM ({inner})"
    b = config.bands
    names = config.band_names
    band = f"CASE WHEN risk_score <= {b[0]} THEN '{names[0]}' " + " ".join(f"WHEN risk_score < {x} THEN '{n}'" for x, n in zip(b[1:], names[1:])) + f" ELSE '{names[-1]}' END"
    tier = f"CASE WHEN amount >= {config.high_amount} AND risk_score >= {b[2]} THEN 1 WHEN (amount >= {config.high_amount} AND risk_score >= {b[1]}) OR (amount < {config.high_amount} AND risk_score >= {b[2]}) THEN 2 WHEN risk_score > 0 THEN 3 WHEN amount >= {config.high_amount} THEN 4 ELSE 5 END"
    return f"SELECT *, len(fired_markers) AS n_markers, {band} AS risk_band, {tier} AS tier FROM ({middle})"
