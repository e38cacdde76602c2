"""One tender from candidates to a shortlist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filtering
from ..operators.filtering import FilterConfig, Tender


def shortlist(vendors: DataFrame, tender: Tender, config: FilterConfig = FilterConfig(), batch_size: int = 100, batch: int = 1, threshold: float = 40.0) -> dict[str, DataFrame]:  # noqa: B008
    """raw, filtered, batch, all_matches, final_matches and metrics: the tables of a run."""
    capped = filtering.government_cap(vendors, config.max_candidates) if config.max_candidates else vendors
    filtered, metrics = filtering.run_filter(capped.drop("is_government"), tender, config)
    order = [(F.col("preliminary_score") + F.coalesce("geo_score", F.lit(0.0))).desc(), F.col("company_name").desc(), F.col("ord")]
    numbered = filtering.batches(filtered, order, batch_size)
    matches = filtering.match_rows(numbered.where(F.col("batch") == batch), tender, threshold)
    matches = matches.orderBy(F.desc("capability_match_score"), "ord")
    return {"raw_vendors": vendors, "filtered": numbered, "all_matches": matches, "final_matches": matches.where("match_status = 'selected'"), "metrics": metrics}


def top_up(first: DataFrame, metrics: DataFrame, tender: Tender, more: Callable[[int], DataFrame], least: int, config: FilterConfig = FilterConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """If fewer than `least` are left, asks for as many more and filters all again; the metrics of both passes."""
    n = first.count()
    if n >= least:
        return first, metrics, metrics
    late = more(least - n)
    both = first.unionByName(late, allowMissingColumns=True)
    again, second = filtering.run_filter(both.select(*late.columns), tender, config)
    return again, metrics, second


def profile(api: DataFrame, structured: DataFrame, key: str = "tender_id") -> DataFrame:
    """Tender values from both sides: codes of the document come before those of the notice, as does its state."""
    rows = api.join(structured.select(key, F.col("naics_codes").alias("_n"), F.col("location").alias("_l"), "project_type", "sector"), key, "left")
    return rows.withColumn("naics", F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.col("naics"))).withColumn("state_province", F.coalesce("_l.state_province", "state_province")).withColumn("city", F.coalesce("_l.city", "city")).drop("_n", "_l")


def merged_codes(*lists: str):
    """Codes of several lists, each once, in order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(F.col(c), empty) for c in lists]), lambda x: F.trim(x) != ""))


def key_requirements(structured: DataFrame, key: str = "tender_id") -> DataFrame:
    """(key, requirement_id, type, description, must_have) from the fields of a document: experience, licences and
    certificates; capabilities only where none of these is asked for."""
    r = F.col("vendor_requirements")
    words = F.col("technical_keywords") if "technical_keywords" in structured.columns else F.array().cast("array<string>")
    one = lambda kind, text, must: F.struct(F.lit(kind).alias("type"), text.alias("description"), F.lit(must).alias("must_have"))
    listed = lambda label, c, n: F.concat(F.lit(label), F.array_join(F.slice(c, 1, n), ", "))
    asked = F.array_compact(
        F.array(
            F.when(r["min_years"] > 0, one("experience", F.concat(F.lit("Minimum "), r["min_years"].cast("string"), F.lit(" years of relevant project experience")), True)),
            F.when(F.size(r["licences"]) > 0, one("license", listed("Licenses: ", r["licences"], 5), True)),
            F.when(F.size(r["certificates"]) > 0, one("certification", listed("Certifications: ", r["certificates"], 5), True)),
        )
    )
    other = F.array_compact(F.array(F.when(F.size(words) > 0, one("capability", listed("Capabilities: ", words, 6), False))))
    rows = structured.select(key, F.posexplode(F.when(F.size(asked) > 0, asked).otherwise(other)).alias("i", "q"))
    return rows.select(key, F.concat(F.lit("REQ-"), F.lpad((F.col("i") + 1).cast("string"), 3, "0")).alias("requirement_id"), "q.*")


def requirement_summary(row_cols: dict[str, str], each: int = 600):
    """A tender's requirements for a scorer: the parts that are there, the fewer the longer."""
    there = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(label).alias("label"), F.col(c).alias("text"))) for label, c in row_cols.items()]))
    share = (F.lit(each * len(row_cols)) / F.greatest(F.size(there), F.lit(1))).cast("int")
    return F.array_join(F.transform(there, lambda p: F.concat(p["label"], F.lit(": "), F.left(p["text"], share))), "\n")
