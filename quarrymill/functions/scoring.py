"""Scores, reasons and statuses of vendors. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import SCORED_SOURCES, SET_ASIDES
from .names import given, truthy


def set_aside_reason(code: Column, types: Column) -> Column:
    """Why a vendor of these business types fails a set-aside, null if it doesn't. Unknown codes let all pass."""
    wanted = F.element_at(F.create_map(*[x for k, v in SET_ASIDES.items() for x in (F.lit(k), F.array(*[F.lit(t.lower()) for t in v]))]), code)
    low = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower)
    return F.when(
        wanted.isNotNull(),
        F.when(F.size(low) == 0, F.concat(F.lit("set_aside_missing_"), code)).when(~F.arrays_overlap(low, wanted), F.concat(F.lit("set_aside_mismatch_"), code)),
    )


def size_reason(tender_value: Column, vendor_value: Column, ratio: float = 0.1) -> Column:
    """A known contract history below a share of the tender's value; unknown values pass."""
    return F.when((tender_value > 0) & (vendor_value > 0) & (vendor_value < tender_value * ratio), "insufficient_contract_history")


def preliminary_score(past_winner: Column, flags: Column, source: Column, tender_value: Column, vendor_value: Column) -> Column:
    plus = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    return (
        F.lit(50.0) + plus(past_winner, 15) + plus(F.array_contains(flags, "high_value_supplier"), 10) + plus(F.array_contains(flags, "frequent_supplier"), 10)
        + plus(source.isin(SCORED_SOURCES), 5) + plus(truthy(tender_value) & truthy(vendor_value) & (vendor_value >= tender_value), 10)
    )


def rule_score(website: Column, content: Column, flags: Column, past_winner: Column, source: Column, has_contact: Column, code_similarity: Column) -> Column:
    """Capability without a scorer: what is known of the vendor, and how its industry codes fit."""
    plus = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    base = F.when(given(website) & given(content), 45.0).when(given(website), 35.0).otherwise(25.0)
    own = base + plus(F.array_contains(flags, "high_value_supplier"), 20) + plus(F.array_contains(flags, "frequent_supplier"), 15) + plus(past_winner, 10)
    own = own + plus(source == "canada_contracts", 5) - plus(~has_contact, 10)
    return F.least(F.least(own, F.lit(100.0)) + code_similarity * 20.0, F.lit(100.0))


def rationale(name: Column, flags: Column, past_winner: Column, location: Column, project_type: Column, code_similarity: Column) -> Column:
    return F.concat(
        F.concat_ws(
            " - ", name, F.when(code_similarity >= 0.7, "industry match (NAICS aligned)"),
            F.when(F.array_contains(flags, "high_value_supplier"), "extensive contract history (>$100M CAD)"),
            F.when(F.array_contains(flags, "frequent_supplier"), "frequent supplier (>50 contracts)"),
            F.when(past_winner, "past contract experience"),
            F.when(given(location), F.concat(F.lit("located in "), location)),
            F.when(given(project_type), F.concat(F.lit("for "), project_type, F.lit(" requirements"))),
        ),
        F.lit("."),
    )


def parsed_score(response: Column) -> Column:
    """The score of a scorer's JSON answer, from 0 to 100; null if it is missing or not finite."""
    body = F.regexp_replace(F.trim(response), r"(?s)^```(?:json)?\s*|\s*```$", "")
    x = F.get_json_object(body, "$.score").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def match_status(method: Column, score: Column, threshold: float) -> Column:
    return F.when(F.coalesce(method, F.lit("")) == "rule_based", "needs_review").when(score >= threshold, "selected").otherwise("needs_review")


def match_reason(method: Column, score: Column, threshold: float, scrape_error: Column, content: Column, email: Column, phone: Column) -> Column:
    shown = F.format_string("%.1f", score)
    return (
        F.when(F.coalesce(method, F.lit("")) == "rule_based", "Heuristic ranking only; capability assessment unavailable")
        .when(score >= threshold, F.concat(F.lit("Meets score threshold ("), shown, F.lit(")")))
        .when(given(scrape_error), F.concat(F.lit("Website not captured: "), scrape_error))
        .when(~given(content), "No website content available")
        .when(~given(email) & ~given(phone), "Missing contact details")
        .otherwise(F.concat(F.lit("Score below threshold ("), shown, F.lit(")")))
    )
