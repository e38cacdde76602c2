"""Filtering and ranking of candidates for one tender or many.

`vendors` has the vendor columns and `ord`; `tender` is a plain object of the few values that rules need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..session import checkpointed
from . import resolve

# Sources of governments, for the cap.
GOVERNMENT_SOURCES = ["sam_entity", "canada_contracts", "canada_award_notices", "canada_odbus", "canada_pspc_payments", "canada_sosa"]


@dataclass(frozen=True)
class Tender:
    city: str | None = None
    state: str | None = None
    country: str | None = None
    set_aside: str | None = None
    value: float | None = None
    naics: tuple[str, ...] = ()
    project_type: str | None = None

    def lit(self, name: str) -> Column:
        v = getattr(self, name)
        return F.lit(v).cast("double" if name == "value" else "string")


@dataclass(frozen=True)
class FilterConfig:
    duplicates: bool = True
    geographic: bool = True
    eligibility: bool = True
    local_first: bool = True
    sort_by_distance: bool = False
    expansion_threshold: int = 50
    set_aside: bool = True
    size: bool = True
    size_ratio: float = 0.1
    max_candidates: int | None = 500


def with_geo(vendors: DataFrame, tender: Tender) -> DataFrame:
    state, country = tender.lit("state"), F.coalesce(tender.lit("country"), F.lit("United States"))
    vendors = vendors.withColumn("geo_score", geo.geo_score(tender.lit("city"), state, F.col("state"), country))
    return vendors.withColumn("geo_tier", geo.geo_tier(state, F.col("state"), country))


def geo_filter(vendors: DataFrame, tender: Tender, config: FilterConfig, expansion: bool) -> DataFrame:
    """Scores and tiers. Without a tender state nobody is judged; else the national tier goes unless the
    filter only sorts or expands."""
    if not config.local_first:
        return with_geo(vendors, tender).withColumn("geo_tier", F.lit(None).cast("string"))
    if not tender.state:
        return vendors.withColumn("geo_score", F.coalesce("geo_score", F.lit(0.0)) if "geo_score" in vendors.columns else F.lit(0.0)).withColumn("geo_tier", F.lit(None).cast("string"))
    scored = with_geo(vendors, tender)
    return scored if config.sort_by_distance or expansion else scored.where("geo_tier <> 'national'")


def with_reason(vendors: DataFrame, tender: Tender, config: FilterConfig = FilterConfig()) -> DataFrame:  # noqa: B008
    """exclusion_reason: the first rule that a vendor fails, null for eligible ones."""
    none = F.lit(None).cast("string")
    code = F.when(F.coalesce(tender.lit("set_aside"), F.lit("NONE")) != "NONE", tender.lit("set_aside"))
    aside = scoring.set_aside_reason(code, F.col("business_types")) if config.set_aside else none
    size = scoring.size_reason(tender.lit("value"), F.col("total_contract_value"), config.size_ratio) if config.size else none
    return vendors.withColumn("exclusion_reason", F.coalesce(aside, size))


def reason_histogram(reasoned: DataFrame) -> DataFrame:
    return reasoned.where("exclusion_reason is not null").groupBy("exclusion_reason").agg(F.count("*").alias("n"))


def with_preliminary(vendors: DataFrame, tender: Tender) -> DataFrame:
    return vendors.withColumn("preliminary_score", scoring.preliminary_score(F.col("is_past_winner"), F.col("enrichment_flags"), F.col("source"), tender.lit("value"), F.col("total_contract_value")))


def ranked(vendors: DataFrame, most: int | None = None) -> DataFrame:
    """By score, then by name, both from the top; then tiers and arrival. A limit becomes a top-k, without a full sort."""
    tier = geo.tier_rank(F.col("geo_tier")) if "geo_tier" in vendors.columns else F.lit(2)
    out = vendors.orderBy((F.col("preliminary_score") + F.coalesce("geo_score", F.lit(0.0))).desc(), F.col("company_name").desc(), tier, "ord")
    return out.limit(most) if most else out


def government_cap(vendors: DataFrame, max_candidates: int, share: float = 0.7) -> DataFrame:
    """The first int(max * share) vendors of government sources, in order, before all others. The cap is a top-k."""
    own = F.col("source").isin(GOVERNMENT_SOURCES)
    first = vendors.where(own).orderBy("ord").limit(int(max_candidates * share)).withColumn("is_government", F.lit(True))
    return first.unionByName(vendors.where(~F.coalesce(own, F.lit(False))).withColumn("is_government", F.lit(False)))


def batches(vendors: DataFrame, order: list[Column], size: int) -> DataFrame:
    """batch: 1, 2, ... in the given order, `size` rows each. For a ranked, capped list."""
    return vendors.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int") + 1)


def run_filter(vendors: DataFrame, tender: Tender, config: FilterConfig = FilterConfig()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The ranked candidates and one row of metrics. Stages: duplicates, geography, eligibility, ranking, cap."""
    unique = checkpointed(resolve.deduplicate(vendors)) if config.duplicates else vendors
    total, left = vendors.count(), unique.count()
    geographic = config.geographic
    placed = geo_filter(unique, tender, config, left < config.expansion_threshold) if geographic else unique.withColumn("geo_score", F.lit(0.0)).withColumn("geo_tier", F.lit(None).cast("string"))
    reasoned = with_reason(placed, tender, config) if config.eligibility else placed.withColumn("exclusion_reason", F.lit(None).cast("string"))
    reasoned = checkpointed(reasoned)
    out = ranked(with_preliminary(reasoned.where("exclusion_reason is null"), tender), config.max_candidates)
    judged = geographic and config.local_first and tender.state is not None
    tiers = with_geo(unique, tender) if judged else unique.withColumn("geo_tier", F.lit("national" if geographic else None))
    metrics = tiers.agg(F.count_if(F.col("geo_tier") == "local").alias("local_vendors"), F.count_if(F.col("geo_tier") == "national").alias("national_vendors"))
    reasons = reason_histogram(reasoned).agg(
        F.map_from_entries(F.collect_list(F.struct("exclusion_reason", "n"))).alias("filter_reasons"), F.coalesce(F.sum("n"), F.lit(0)).alias("eligibility_filtered")
    )
    eligible = reasoned.agg(F.count_if(F.col("exclusion_reason").isNull()).alias("e"))
    final = F.least(F.col("e"), F.lit(config.max_candidates)) if config.max_candidates else F.col("e")
    metrics = metrics.join(reasons).join(eligible).select(  # three tables of one row
        F.lit(total).alias("total_input"), F.lit(total - left).alias("duplicates_removed"), "local_vendors", "national_vendors",
        F.col("national_vendors").alias("geo_filtered"), "eligibility_filtered", "filter_reasons", final.alias("final_count"),
    )
    return out, metrics


def match_rows(vendors: DataFrame, tender: Tender, threshold: float = 40.0) -> DataFrame:
    """Rule-based scores, rationales, statuses and reasons of vendors that may have website_content and naics_codes."""
    cols = set(vendors.columns)
    opt = lambda name, kind="string": F.col(name) if name in cols else F.lit(None).cast(kind)
    from ..functions.names import given
    from ..functions.similarity import code_similarity

    wanted = F.array(*[F.lit(c) for c in tender.naics]).cast("array<string>")
    fit = code_similarity(wanted, F.coalesce(opt("naics_codes", "array<string>"), F.array().cast("array<string>")))
    contact = given(F.col("email")) | given(F.col("phone")) | opt("contact_name").isNotNull()
    out = vendors.withColumn("naics_similarity", fit)
    score = scoring.rule_score(F.col("website"), opt("website_content"), F.col("enrichment_flags"), F.coalesce("is_past_winner", F.lit(False)), F.col("source"), contact, F.col("naics_similarity"))
    method, captured = F.lit("rule_based"), None
    if "scorer_response" in cols:
        captured = scoring.parsed_score(F.col("scorer_response"))
        method = F.when(captured.isNull(), "rule_based").otherwise("llm")
    out = out.withColumn("capability_match_score", F.coalesce(captured, score) if captured is not None else score).withColumn("scoring_method", method)
    out = out.withColumn("rationale", scoring.rationale(F.col("company_name"), F.col("enrichment_flags"), F.coalesce("is_past_winner", F.lit(False)), F.col("location"), tender.lit("project_type"), F.col("naics_similarity")))
    s, m = F.col("capability_match_score"), F.col("scoring_method")
    out = out.withColumn("match_status", scoring.match_status(m, s, threshold))
    return out.withColumn("match_reason", scoring.match_reason(m, s, threshold, opt("scrape_error"), opt("website_content"), F.col("email"), F.col("phone")))
