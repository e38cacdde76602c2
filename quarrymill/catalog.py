"""Registered queries of the vendor engine, each over its whole tables, with oracle SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import cleaning, contacts, documents, geo, names, pages, scoring, similarity
from .operators import discovery, enrich, filtering, ingest, nearest, registry, resolve, sections, writeback
from .operators.filtering import FilterConfig, Tender
from .session import checkpointed, step_dir
from .sources import sinks
from .sources.store import Change, Store, append_new

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

V = "WITH v AS (" + X.plain(X.VENDORS) + ") "
TENDER = Tender(city="Boston", state="Massachusetts", country="United States", set_aside="SBA", value=1_000_000.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# names, addresses, keys

_DEDUP = "lower(trim(company_name))"
for _s in ["\\s+inc\\.?$", "\\s+llc\\.?$", "\\s+ltd\\.?$", "\\s+corporation$", "\\s+corp\\.?$", "\\s+limited$", "\\s+company$", "\\s+co\\.?$", "\\s+incorporated$", "\\s+s\\.?a\\.?$", "\\s+gmbh$"]:
    _DEDUP = f"regexp_replace({_DEDUP}, '{_s}', '')"
_DEDUP = f"trim(regexp_replace(regexp_replace({_DEDUP}, '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(V + f"SELECT ord, {_DEDUP} AS dedup_name, trim(regexp_replace(regexp_replace(trim(regexp_replace(upper(trim(company_name)), '\\b(INC\\.?|INCORPORATED|CORP\\.?|CORPORATION|LTD\\.?|LIMITED|LLC\\.?|CO\\.?|COMPANY)$', '')), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS match_name, regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g') AS compact_name FROM v")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("company_name")
    return X.vendors(spark, sf_dir).select("ord", names.dedup_name(n).alias("dedup_name"), names.match_name(n).alias("match_name"), names.compact(n).alias("compact_name"))


_AUTH = "nullif(regexp_extract(CASE WHEN lower(website) LIKE 'http%://%' THEN lower(website) ELSE 'https://' || lower(website) END, '^[a-z]+://([^/?#]*)', 1), '')"


@query(V + f"SELECT ord, CASE WHEN website IS NOT NULL THEN replace({_AUTH}, 'www.', '') END AS website_key, regexp_replace(lower(coalesce(regexp_extract(website, '^[A-Za-z]+://([^/?#]*)', 1), '')), '^www\\.', '') AS domain, nullif(regexp_extract(CASE WHEN website LIKE '%://%' THEN website ELSE 'https://' || website END, '^(https?://[^/?#]+)', 1), '') AS base_url, coalesce('uei:' || upper(uei), 'cage:' || upper(cage_code)) AS identifier FROM v")
def vendor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("website")
    return X.vendors(spark, sf_dir).select("ord", names.website_key(w).alias("website_key"), names.domain(w).alias("domain"), names.base_url(w).alias("base_url"), names.identifier_key(F.col("uei"), F.col("duns"), F.col("cage_code")).alias("identifier"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain, list_extract(string_split(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', ''), '.'), -2) AS root FROM pages")
def domain_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = names.domain(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", d.alias("domain"), names.domain_root(d).alias("root"))


@query("WITH r AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages) SELECT domain, min(page_id) AS page_id FROM r GROUP BY domain")
def first_page_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", names.domain(F.col("url")).alias("domain"))
    return resolve.first_by_key(rows, F.col("domain"), "page_id").select("domain", "page_id")


# cleaning


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,6)) AS DOUBLE) END AS amount, 'K' || (o_custkey % 10) || 'A' || (o_orderkey % 10) || 'B' || (o_custkey % 7) AS postal, upper(substr(o_orderpriority, 3, 2)) AS state FROM orders")
def cleaned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 5 == 0, "2025-13-45").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-M-d"), F.lit("T00:00")))
    day = F.when(F.col("o_orderkey") % 5 == 0, day).otherwise(F.left(day, F.instr(day, "T") - 1))
    amount = F.when(F.col("o_orderkey") % 7 == 0, "about 12").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    postal = F.concat(F.lit(" k"), F.col("o_custkey") % 10, F.lit("a "), F.col("o_orderkey") % 10, F.lit("b"), F.col("o_custkey") % 7, F.lit("99"))
    return o.select(
        "o_orderkey", cleaning.iso_date(day).alias("day"), cleaning.decimal(amount).cast("double").alias("amount"), cleaning.postal_code(postal).alias("postal"), cleaning.state_code(F.substr("o_orderpriority", F.lit(3))).alias("state")
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, array_to_string(CASE o_orderkey % 3 WHEN 0 THEN [o_orderpriority, o_orderstatus] WHEN 1 THEN [o_orderpriority || ', ' || o_orderstatus] ELSE [o_orderpriority, o_orderstatus, 'x'] END, '/') AS parts, 'City ' || (o_custkey % 9) AS city FROM orders")
def parsed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.date_format("o_orderdate", "MMMM d")
    dated = F.concat(text, F.when(F.col("o_orderkey") % 2 == 0, "th").otherwise(""), F.lit(", "), F.date_format("o_orderdate", "yyyy"))
    k, p, s = F.col("o_orderkey") % 3, F.col("o_orderpriority"), F.col("o_orderstatus")
    field = F.when(k == 0, F.concat(p, F.lit(" ; "), s)).when(k == 1, F.concat(p, F.lit(", "), s, F.lit("*"))).otherwise(F.concat(F.lit("| "), p, F.lit(" |"), s, F.lit("|x")))
    place = cleaning.city_province(F.concat(F.lit("City "), F.col("o_custkey") % 9, F.lit(" , ON")))
    return o.select("o_orderkey", cleaning.english_date(dated).alias("iso"), F.array_join(cleaning.split_present(field), "/").alias("parts"), place["city"].alias("city"))


# entity resolution


RESOLVE_SQL = V.replace("WITH", "WITH RECURSIVE", 1) + f""",
n AS (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM (SELECT ord, coalesce('uei:' || upper(trim(uei)), 'duns:' || duns, 'cage:' || upper(trim(cage_code))) AS id, nullif(CASE WHEN website IS NOT NULL THEN replace({_AUTH}, 'www.', '') END, '') AS site, {_DEDUP} AS name FROM v)),
k AS (SELECT *, list_filter(['0' || id, '1' || site, '2' || name], lambda x: x IS NOT NULL) AS own FROM n),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS held, CAST([] AS BIGINT[]) AS kept UNION ALL
         SELECT k.rn, CASE WHEN list_has_any(held, own) THEN held ELSE held || own END, CASE WHEN list_has_any(held, own) THEN kept ELSE kept || [CAST(ord AS BIGINT)] END FROM walk JOIN k ON k.rn = walk.rn + 1),
kept AS (SELECT k.* FROM k WHERE ord IN (SELECT unnest(kept) FROM walk WHERE rn = (SELECT max(rn) FROM walk)))
SELECT k.ord, CASE WHEN o.ord IS NOT NULL THEN k.ord ELSE coalesce(min(h.ord) FILTER (WHERE h.id = k.id), min(h.ord) FILTER (WHERE h.site = k.site), min(h.ord) FILTER (WHERE h.name = k.name)) END AS survivor
FROM k LEFT JOIN kept o ON o.ord = k.ord LEFT JOIN kept h ON h.ord < k.ord AND (h.id = k.id OR h.site = k.site OR h.name = k.name) GROUP BY k.ord, o.ord"""


@query(RESOLVE_SQL)
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.survivors(X.vendors(spark, sf_dir))


_FILL = ", ".join(f"first({c} ORDER BY ord) FILTER (WHERE {c} IS NOT NULL AND {c} <> '') AS {c}" for c in ("website", "email", "phone", "state", "uei"))


@query(V + f"SELECT ord % 100 AS ord, {_FILL}, bool_or(is_past_winner) AS is_past_winner, max(total_contract_value) AS total_contract_value, max(contract_count) AS contract_count FROM v GROUP BY ord % 100")
def survivorship_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vendors(spark, sf_dir)
    merged = resolve.merge(v, v.select("ord", (F.col("ord") % 100).alias("survivor")))
    return merged.select("ord", "website", "email", "phone", "state", "uei", "is_past_winner", "total_contract_value", "contract_count")


# eligibility, places, ranking

_REASON = """CASE WHEN types = '' THEN 'set_aside_missing_SBA' WHEN NOT (list_contains(string_split(lower(types), ','), '8(a)') OR list_contains(string_split(lower(types), ','), 'small business')) THEN 'set_aside_mismatch_SBA'
  WHEN total_contract_value > 0 AND total_contract_value < 100000.0 THEN 'insufficient_contract_history' END"""
_SCORE = """50.0 + CASE WHEN is_past_winner THEN 15 ELSE 0 END + CASE WHEN flags LIKE '%high_value%' THEN 10 ELSE 0 END + CASE WHEN flags LIKE '%frequent%' THEN 10 ELSE 0 END
  + CASE WHEN source IN ('canada_contracts', 'sam_entity') THEN 5 ELSE 0 END + CASE WHEN total_contract_value >= 1000000.0 THEN 10 ELSE 0 END"""
_TIER = "CASE WHEN state = 'MA' THEN 'local' WHEN state IN ('CT', 'NH', 'NY', 'RI', 'VT') THEN 'regional' ELSE 'national' END"


@query(V + f"SELECT ord, {_REASON} AS exclusion_reason FROM v")
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.with_reason(X.vendors(spark, sf_dir), TENDER).select("ord", "exclusion_reason")


@query(V + f", r AS (SELECT {_REASON} AS exclusion_reason FROM v) SELECT exclusion_reason, count(*) AS n FROM r WHERE exclusion_reason IS NOT NULL GROUP BY 1")
def eligibility_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.reason_histogram(filtering.with_reason(X.vendors(spark, sf_dir), TENDER))


@query(V + f"SELECT ord, {_TIER} AS geo_tier, CASE WHEN state = 'MA' THEN 20.0 WHEN state IN ('CT', 'NH', 'NY', 'RI', 'VT') THEN 10.0 ELSE 0.0 END AS geo_score FROM v")
def geo_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.with_geo(X.vendors(spark, sf_dir), TENDER).select("ord", "geo_tier", "geo_score")


@query(V + f"SELECT ord, {_SCORE} AS preliminary_score FROM v")
def preliminary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.with_preliminary(X.vendors(spark, sf_dir), TENDER).select("ord", "preliminary_score")


@query(V + ", g AS (SELECT ord, row_number() OVER (ORDER BY ord) AS r FROM v WHERE source IN ('sam_entity','canada_contracts','canada_odbus')) SELECT ord, true AS is_government FROM g WHERE r <= 350 UNION ALL SELECT ord, false FROM v WHERE source = 'serper_discovery'")
def government_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.government_cap(X.vendors(spark, sf_dir), 500).select("ord", "is_government")


@query(V + f", s AS (SELECT ord, company_name, {_SCORE} + CASE WHEN state = 'MA' THEN 20 WHEN state IN ('CT', 'NH', 'NY', 'RI', 'VT') THEN 10 ELSE 0 END AS total, {_TIER} AS tier FROM v WHERE {_REASON} IS NULL), r AS (SELECT ord, total, row_number() OVER (ORDER BY total DESC, company_name DESC, CASE tier WHEN 'local' THEN 0 WHEN 'regional' THEN 1 ELSE 2 END, ord) AS place FROM s) SELECT ord, total, CAST((place - 1) // 100 + 1 AS INTEGER) AS batch FROM r WHERE place <= 500")
def ranked_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible vendors ranked, the first 500 in batches of 100."""
    rows = filtering.with_reason(filtering.with_geo(X.vendors(spark, sf_dir), TENDER), TENDER).where("exclusion_reason is null")
    top = filtering.ranked(filtering.with_preliminary(rows, TENDER), 500)
    total = F.col("preliminary_score") + F.col("geo_score")
    order = [total.desc(), F.col("company_name").desc(), geo.tier_rank(F.col("geo_tier")), F.col("ord")]
    return filtering.batches(top, order, 100).select("ord", total.alias("total"), "batch")


@query()
def vendor_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of one tender: duplicates, places, eligibility, ranking, cap, rule-based scores."""
    out, _ = filtering.run_filter(X.vendors(spark, sf_dir), TENDER, FilterConfig(sort_by_distance=True))
    matches = filtering.match_rows(out, TENDER)
    return matches.select("ord", "company_name", "geo_tier", "geo_score", "preliminary_score", "capability_match_score", "rationale", "match_status")


@query(V + f", r AS (SELECT *, {_REASON} AS reason, {_TIER} AS tier FROM v) SELECT count(*) AS total_input, 0 AS duplicates_removed, count(*) FILTER (WHERE tier = 'local') AS local_vendors, count(*) FILTER (WHERE tier = 'national') AS national_vendors, count(*) FILTER (WHERE tier = 'national') AS geo_filtered, count(*) FILTER (WHERE reason IS NOT NULL) AS eligibility_filtered, least(500, count(*) FILTER (WHERE reason IS NULL)) AS final_count FROM r")
def filter_metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the filter that keeps duplicates and sorts by distance."""
    _, metrics = filtering.run_filter(X.vendors(spark, sf_dir), TENDER, FilterConfig(duplicates=False, sort_by_distance=True))
    return metrics.drop("filter_reasons")


@query()
def filter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = filtering.run_filter(X.vendors(spark, sf_dir), TENDER)
    return metrics.drop("filter_reasons")


_RULE = "least(100.0, CASE WHEN website IS NOT NULL THEN 35.0 ELSE 25.0 END + CASE WHEN flags LIKE '%high_value%' THEN 20 ELSE 0 END + CASE WHEN flags LIKE '%frequent%' THEN 15 ELSE 0 END + CASE WHEN is_past_winner THEN 10 ELSE 0 END + CASE WHEN source = 'canada_contracts' THEN 5 ELSE 0 END - CASE WHEN email IS NULL AND phone IS NULL THEN 10 ELSE 0 END)"
_RULE_REASON = "'Heuristic ranking only; capability assessment unavailable'"


@query(V + f"SELECT ord, {_RULE} AS capability_match_score, 'needs_review' AS match_status, {_RULE_REASON} AS match_reason, company_name || CASE WHEN flags LIKE '%high_value%' THEN ' - extensive contract history (>$100M CAD)' ELSE '' END || CASE WHEN flags LIKE '%frequent%' THEN ' - frequent supplier (>50 contracts)' ELSE '' END || CASE WHEN is_past_winner THEN ' - past contract experience' ELSE '' END || '.' AS rationale FROM v")
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.match_rows(X.vendors(spark, sf_dir), TENDER).select("ord", "capability_match_score", "match_status", "match_reason", "rationale")


@query(V + "SELECT ord, CASE WHEN ord % 4 = 0 THEN NULL ELSE greatest(0.0, least(100.0, CAST(ord % 130 - 10 AS DOUBLE))) END AS score, CASE WHEN ord % 4 = 0 THEN 'needs_review' WHEN greatest(0, least(100, ord % 130 - 10)) >= 40 THEN 'selected' ELSE 'needs_review' END AS status FROM v")
def scorer_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vendors(spark, sf_dir)
    answer = F.when(F.col("ord") % 8 == 0, '{"score": NaN}').when(F.col("ord") % 8 == 4, "no answer").otherwise(F.concat(F.lit('```json\n{"score": '), F.col("ord") % 130 - 10, F.lit(', "rationale": "x"}\n```')))
    s = v.select("ord", scoring.parsed_score(answer).alias("score"))
    method = F.when(F.col("score").isNull(), "rule_based").otherwise("llm")
    return s.select("ord", "score", scoring.match_status(method, F.col("score"), 40.0).alias("status"))


@query("WITH p AS (SELECT p_partkey, 100000 + p_partkey * 37 % 900000 AS a, 100000 + p_partkey * 53 % 900000 AS b FROM part) SELECT p_partkey, CASE WHEN a = b THEN 1.0 WHEN a // 100 = b // 100 THEN 0.7 WHEN a // 10000 = b // 10000 THEN 0.4 ELSE 0.0 END AS similarity FROM p")
def code_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    code = lambda m: F.array((100_000 + k * m % 900_000).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", similarity.code_similarity(code(37), code(53)).alias("similarity"))


def _ellipsoid(pairs: str) -> str:
    """CTEs from pairs (q, e, lat1, lon1, lat2, lon2) to m (q, e, miles): the iteration on the longitude of the auxiliary sphere."""
    return f"""u AS (SELECT q, e, atan((1 - f) * tan(radians(lat1))) AS u1, atan((1 - f) * tan(radians(lat2))) AS u2, radians(lon2 - lon1) AS l FROM ({pairs}), (SELECT 1 / 298.257223563::DOUBLE AS f)),
it AS (SELECT q, e, u1, u2, l, 0 AS n, l AS lam, 1 / 298.257223563::DOUBLE AS f, 0::DOUBLE AS s, 0::DOUBLE AS mid, 1::DOUBLE AS c2 FROM u UNION ALL
  SELECT q, e, u1, u2, l, n + 1, l + (1 - c) * f * sa * (arc + c * ss * (m + c * cs * (2 * m * m - 1))), f, arc, m, k2 FROM (
    SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs, atan2(ss, cs) AS arc,
           coalesce(cos(u1) * cos(u2) * sin(lam) / nullif(ss, 0), 0) AS sa, 1 - sa * sa AS k2, cs - coalesce(2 * sin(u1) * sin(u2) / nullif(k2, 0), 0) AS m, f / 16 * k2 * (4 + f * (4 - 3 * k2)) AS c FROM it WHERE n < 9)),
m AS (SELECT q, e, (6378137 * (1 - f) * big * (s - b * sin(s) * (mid + b / 4 * (cos(s) * (2 * mid * mid - 1) - b / 6 * mid * (4 * pow(sin(s), 2) - 3) * (4 * mid * mid - 3))))) / 1609.344 AS miles FROM (
    SELECT *, c2 * (1 / pow(1 - f, 2) - 1) AS v, 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v))) AS big, v / 1024 * (256 + v * (-128 + v * (74 - 47 * v))) AS b FROM it WHERE n = 9))"""


@query("WITH RECURSIVE " + _ellipsoid("SELECT s_nationkey AS q, s_suppkey AS e, 42.36 AS lat1, -71.06 AS lon1, 30 + s_nationkey AS lat2, -120 + 2 * s_nationkey AS lon2 FROM supplier") + " SELECT e AS s_suppkey, round(miles, 3) AS miles, CASE WHEN miles <= 50 THEN 1.0 WHEN miles <= 200 THEN 0.9 WHEN miles <= 500 THEN 0.7 WHEN miles <= 1000 THEN 0.5 WHEN miles <= 2000 THEN 0.3 WHEN miles <= 3000 THEN 0.1 ELSE 0.05 END AS band FROM m")
def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    m = geo.miles(F.lit(42.36), F.lit(-71.06), 30 + n, -120 + 2 * n)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(m, 3).alias("miles"), geo.distance_score(m).alias("band"))


_ENTITY_AT = "CASE WHEN s_suppkey % 17 <> 0 THEN 25 + s_suppkey * 37 % 2400 / 100.0 END AS lat, -125 + s_suppkey * 91 % 5800 / 100.0 AS lon"
_TENDER_AT = "25 + c_custkey * 61 % 2400 / 100.0 AS lat, -125 + c_custkey * 29 % 5800 / 100.0 AS lon"


@query("WITH RECURSIVE c AS (" + X.plain(X.CODES) + f"), e AS (SELECT concat('s', s_suppkey) AS key, {_ENTITY_AT} FROM supplier WHERE concat('s', s_suppkey) IN (SELECT vendor_key FROM c WHERE code LIKE '23%' OR code LIKE '54%')), t AS (SELECT c_custkey, {_TENDER_AT} FROM customer), "
       + _ellipsoid("SELECT t.c_custkey AS q, e.key AS e, t.lat AS lat1, t.lon AS lon1, e.lat AS lat2, e.lon AS lon2 FROM t, e WHERE e.lat IS NOT NULL")
       + ", d AS (SELECT * FROM m UNION ALL SELECT c_custkey, key, 999999 FROM t, e WHERE e.lat IS NULL), n AS (SELECT q AS tender, e AS vendor_key, round(miles, 4) AS miles, CAST(row_number() OVER (PARTITION BY q ORDER BY miles, e) AS INTEGER) AS place FROM d) SELECT * FROM n WHERE place <= 5")
def nearest_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vendors of two industries for every tender."""
    coded = registry.with_code_prefix(X.view(spark, sf_dir, X.CODES), ["23", "54"])
    e = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS key", *_ENTITY_AT.split(", ")).join(coded, F.col("key") == F.col("vendor_key"), "left_semi")
    tenders = table(spark, sf_dir, "customer").selectExpr("c_custkey AS question", *_TENDER_AT.split(", "))
    return nearest.nearest(tenders, e, k=5).select(F.col("question").alias("tender"), F.col("key").alias("vendor_key"), F.round("miles", 4).alias("miles"), "place")


@query("WITH RECURSIVE x AS (SELECT c_custkey, c_nationkey AS n, CASE c_nationkey % 5 WHEN 0 THEN 'NM' WHEN 1 THEN 'TX' WHEN 2 THEN 'MA' WHEN 3 THEN 'ZZ' ELSE '' END AS state, CASE WHEN c_custkey % 3 = 0 THEN ' Santa Fe' WHEN c_custkey % 3 = 1 THEN 'Roswell' ELSE 'Other' END AS city FROM customer), "
       "p AS (SELECT *, CASE WHEN state = 'NM' AND city = ' Santa Fe' THEN 35.687 WHEN state = 'NM' AND city = 'Roswell' THEN 33.3943 WHEN state = 'NM' THEN 34.840515 WHEN state = 'TX' THEN 31.054487 WHEN state = 'MA' THEN 42.230171 END AS lat, "
       "CASE WHEN state = 'NM' AND city = ' Santa Fe' THEN -105.9378 WHEN state = 'NM' AND city = 'Roswell' THEN -104.523 WHEN state = 'NM' THEN -106.248482 WHEN state = 'TX' THEN -97.563461 WHEN state = 'MA' THEN -71.530106 END AS lon FROM x), "
       + _ellipsoid("SELECT c_custkey AS q, 0 AS e, 35.0844 AS lat1, -106.6504 AS lon1, lat AS lat2, lon AS lon2 FROM p WHERE lat IS NOT NULL")
       + ", d AS (SELECT c_custkey, state, coalesce(round(miles, 2), 999999) AS distance_miles FROM p LEFT JOIN m ON q = c_custkey) SELECT c_custkey, distance_miles, CASE WHEN state = '' THEN 0.0 WHEN distance_miles <= 50 THEN 1.0 WHEN distance_miles <= 200 THEN 0.9 WHEN distance_miles <= 500 THEN 0.7 WHEN distance_miles <= 1000 THEN 0.5 WHEN distance_miles <= 2000 THEN 0.3 ELSE 0.1 END AS distance_score FROM d")
def entity_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities from near to far of a project, by town or state."""
    n, c = F.col("c_nationkey") % 5, F.col("c_custkey") % 3
    state = F.when(n == 0, "NM").when(n == 1, "TX").when(n == 2, "MA").when(n == 3, "ZZ").otherwise("")
    e = table(spark, sf_dir, "customer").select("c_custkey", state.alias("state"), F.when(c == 0, " Santa Fe").when(c == 1, "Roswell").otherwise("Other").alias("city"))
    return nearest.by_distance(e, 35.0844, -106.6504, "c_custkey").select("c_custkey", "distance_miles", "distance_score")


# registry

R = "WITH r AS (" + X.plain(X.REGISTRY) + "), c AS (" + X.plain(X.CODES) + ") "


@query(R + ", f AS (SELECT * FROM r WHERE source IN ('canada_contracts', 'canada_odbus')), p AS (SELECT vendor_key, 1 AS arm, row_number() OVER (ORDER BY total_contract_value DESC, contract_count DESC NULLS LAST, vendor_key) AS n FROM f WHERE total_contract_value IS NOT NULL), o AS (SELECT vendor_key, 2 AS arm, row_number() OVER (ORDER BY legal_name, vendor_key) AS n FROM f WHERE total_contract_value IS NULL AND source = 'canada_odbus') SELECT vendor_key, arm FROM p WHERE n <= 35 UNION ALL SELECT vendor_key, arm FROM o WHERE n <= 15")
def registry_two_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.two_arms(registry.search(X.view(spark, sf_dir, X.REGISTRY)), 50).select("vendor_key", "arm")


@query(R + "SELECT vendor_key FROM r WHERE source IN ('canada_contracts', 'canada_odbus') AND state IN ('Quebec', 'QC') AND (vendor_key IN (SELECT vendor_key FROM c WHERE code = '07' OR substr(code, 1, 2) IN ('12', '33')) OR lower(legal_name) LIKE '%00007%')")
def hierarchical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry.search(X.view(spark, sf_dir, X.REGISTRY), X.view(spark, sf_dir, X.CODES), gsin_codes=["1234", "33 "], keywords=["00007"], province="Quebec")
    return found.select("vendor_key")


@query(R + "SELECT count(*) AS total_vendors, sum(total_contract_value) AS total_contract_value, (SELECT count(*) FROM c WHERE vendor_key IN (SELECT vendor_key FROM r WHERE source IN ('canada_contracts', 'canada_odbus'))) AS total_gsin_codes, (SELECT count(*) FROM c WHERE vendor_key IN (SELECT vendor_key FROM r WHERE source IN ('canada_contracts', 'canada_odbus')) AND code LIKE '1%') AS total_unspsc_codes FROM r WHERE source IN ('canada_contracts', 'canada_odbus')")
def registry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = X.view(spark, sf_dir, X.CODES)
    return registry.statistics(X.view(spark, sf_dir, X.REGISTRY), codes, codes.where("code like '1%'"))


@query(R + "SELECT source, count(*) AS n_vendors, count(k.vendor_key) AS n_coded, CAST(count(k.vendor_key) AS DOUBLE) / count(*) AS coverage FROM r LEFT JOIN (SELECT DISTINCT vendor_key FROM c WHERE code LIKE '4%') k USING (vendor_key) GROUP BY source")
def code_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.coverage(X.view(spark, sf_dir, X.REGISTRY), X.view(spark, sf_dir, X.CODES).where("code like '4%'"))


@query(V + "SELECT count(*) AS n, count(email) AS n_email, count(phone) AS n_phone, count(website) AS n_website FROM v")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.filled(X.vendors(spark, sf_dir), "email", "phone", "website")


@query(V + "SELECT source, count(*) AS n FROM v GROUP BY source")
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.source_histogram(X.vendors(spark, sf_dir))


_MATCH = "trim(regexp_replace(regexp_replace(trim(regexp_replace(upper(trim({})), '\\b(INC\\.?|INCORPORATED|CORP\\.?|CORPORATION|LTD\\.?|LIMITED|LLC\\.?|CO\\.?|COMPANY)$', '')), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_HOLDS_ALL = "CAST(18446744073709551615 AS HUGEINT)"  # 64 bits
CROSS_SQL = V + ", r AS (" + X.plain(X.REGISTRY) + f"""),
a AS (SELECT vendor_key, lower(city) AS city, {_MATCH.format("company_name")} AS name FROM v), b AS (SELECT vendor_key AS match_key, lower(city) AS city, {_MATCH.format("regexp_replace(legal_name, 'Supplier#0*', 'Vendor ')")} AS name FROM r),
pairs AS (SELECT DISTINCT a.name AS x, b.name AS y FROM a JOIN b ON a.city = b.city),
masks AS (SELECT x, y, list_transform(string_split(y, ''), lambda c: CAST(coalesce(list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] = c THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE 0 END)), 0) AS HUGEINT)) AS m FROM pairs),
lcs AS (SELECT x, y, len(x) - bit_count(list_reduce([{_HOLDS_ALL}] || m, lambda s, k: ((s + (s & k)) | (s - (s & k))) & {_HOLDS_ALL}) & ((CAST(1 AS HUGEINT) << CAST(len(x) AS INTEGER)) - 1)) AS lcs,
               list_distinct(list_filter(string_split(x, ' '), lambda w: w <> '')) AS wx, list_distinct(list_filter(string_split(y, ' '), lambda w: w <> '')) AS wy FROM masks),
sims AS (SELECT x, y, greatest(2.0::DOUBLE * lcs / (len(x) + len(y)), len(list_intersect(wx, wy))::DOUBLE / greatest(len(wx), len(wy))) AS similarity FROM lcs),
placed AS (SELECT vendor_key, match_key, similarity, CAST(row_number() OVER (PARTITION BY vendor_key ORDER BY similarity DESC, match_key) AS INTEGER) AS place FROM a JOIN b ON a.city = b.city JOIN sims ON x = a.name AND y = b.name WHERE similarity >= 0.6)
SELECT * FROM placed WHERE place <= 5"""


@query(CROSS_SQL)
def cross_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry names like the vendors', in their city, by indel similarity."""
    r = X.view(spark, sf_dir, X.REGISTRY).select("vendor_key", F.regexp_replace("legal_name", "Supplier#0*", "Vendor ").alias("legal_name"), "city")
    return registry.cross_reference(X.vendors(spark, sf_dir), r)


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%widget%' OR lower(p_name) LIKE '%12mm%'")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = registry.expand_keywords(["Ring widget", "12mm"])
    return table(spark, sf_dir, "part").where(registry.name_matches(F.col("p_name"), words)).select("p_partkey")


# ingest

C = "WITH f AS (" + X.plain(X.CONTRACTS) + "), x AS (SELECT *, legal_name || '_' || upper(substr(replace(trim(postal_code), ' ', ''), 1, 6)) AS external_id, try_cast(value AS DECIMAL(38, 6)) AS amount, try_cast(nullif(date, '') AS DATE) AS day FROM f) "
_ROLL = "external_id, nullif(CAST(sum(amount) AS DOUBLE), 0) AS total_contract_value, nullif(count(*) FILTER (WHERE amount IS NOT NULL OR day IS NOT NULL), 0) AS contract_count, min(day) AS first_contract_date, max(day) AS last_contract_date"


@query(C + f"SELECT {_ROLL}, count(DISTINCT nullif(gsin, '')) AS n_gsin, count(DISTINCT unspsc) AS n_unspsc, least(100, count(*) FILTER (WHERE amount IS NOT NULL OR day IS NOT NULL)) AS n_history FROM x GROUP BY external_id")
def contract_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.contract_rollup(ingest.contract_rows(X.view(spark, sf_dir, X.CONTRACTS)))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select("external_id", "total_contract_value", "contract_count", "first_contract_date", "last_contract_date", n("gsin_codes").alias("n_gsin"), n("unspsc_codes").alias("n_unspsc"), n("contract_history").alias("n_history"))


@query(C + f"SELECT {_ROLL} FROM x GROUP BY external_id")
def contract_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of one half of the feed with that of the other half merged in."""
    rows = ingest.contract_rows(X.view(spark, sf_dir, X.CONTRACTS))
    cols = ["source", "external_id", "total_contract_value", "contract_count", "first_contract_date", "last_contract_date"]
    old, new = (ingest.contract_rollup(rows.where(F.col("ord") % 2 == i), history=False).select(*cols) for i in (0, 1))
    return ingest.upsert_vendors(old, new).drop("source")


def _roll_up_in_steps(spark: SparkSession, sf_dir: str) -> Store:
    """The feed in three parts rolled up into a store, one of them twice."""
    rows = X.view(spark, sf_dir, X.CONTRACTS)
    store = Store(spark, f"{step_dir(spark)}/store-{uuid.uuid4().hex}")
    known = spark.createDataFrame([], "source string, digest string")
    parts = {part: checkpointed(ingest.chunks(rows.where(F.col("ord") % 3 == part), 2_000)) for part in (0, 1, 2)}
    for part in (0, 1, 0, 2):
        own = parts[part]

        def merge(change: Change, own: DataFrame = own) -> None:
            new, digests = ingest.unseen(own, change.read("ledger", known), "canada_contracts")
            delta = ingest.contract_rollup(ingest.contract_rows(new.drop("chunk")), history=False)
            change.upsert("vendors", delta, ["source", "external_id"], ingest.upsert_vendors, 8)
            change.upsert("ledger", digests, ["source", "digest"], append_new(["source", "digest"]), 8)

        store.transact(merge)
    return store


@query(C + "SELECT " + _ROLL.replace("CAST(sum(amount) AS DOUBLE)", "CAST(sum(amount) AS DECIMAL(18, 2))") + " FROM x GROUP BY external_id")
def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors of a store that took the feed in parts, one of them again."""
    return _roll_up_in_steps(spark, sf_dir).read("vendors").select("external_id", F.col("total_contract_value").cast("decimal(18, 2)").alias("total_contract_value"), "contract_count", "first_contract_date", "last_contract_date")


@query("SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN 'reviewed' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 50 = 7 THEN 0 ELSE round(c_acctbal, 2) END AS c_acctbal FROM customer")
def stored_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's table after updates of some rows, and of keys that it does not hold."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    root = f"{step_dir(spark)}/store-{uuid.uuid4().hex}"
    sinks.write_run(spark, {"matches": (rows, "c_custkey")}, root)
    new = rows.where("c_custkey % 50 = 7").select(F.explode(F.array("c_custkey", -F.col("c_custkey"))).alias("c_custkey"), F.lit("reviewed").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"))
    store = Store(spark, root)
    store.transact(lambda change: change.update("matches", new, ["c_custkey"]))
    return store.read("matches").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))


_CROSSED = CROSS_SQL.replace("a AS (SELECT vendor_key, lower(city) AS city", "a AS (SELECT vendor_key, CASE WHEN source = 'canada_contracts' THEN lower(city) END AS city").replace("WHERE similarity >= 0.6)\nSELECT * FROM placed WHERE place <= 5", "WHERE similarity >= 0.6)")


@query(_CROSSED + ", c AS (" + X.plain(X.CODES) + "), hit AS (SELECT p.vendor_key, count(DISTINCT match_key) AS n, count(DISTINCT code) AS codes FROM placed p JOIN c ON c.vendor_key = p.match_key WHERE place <= 5 GROUP BY p.vendor_key), n AS (SELECT vendor_key, count(*) AS n FROM placed WHERE place <= 5 GROUP BY vendor_key) SELECT v.vendor_key, hit.vendor_key IS NOT NULL AS naics_enriched, CAST(CASE WHEN hit.vendor_key IS NOT NULL THEN n.n END AS INTEGER) AS naics_match_count, coalesce(hit.codes, 0) AS n_codes FROM v LEFT JOIN hit ON hit.vendor_key = v.vendor_key LEFT JOIN n ON n.vendor_key = v.vendor_key")
def codes_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors after their codes were written back, range by range."""
    v = X.vendors(spark, sf_dir).select("vendor_key", F.col("company_name").alias("legal_name"), "city", "source")
    r = X.view(spark, sf_dir, X.REGISTRY).select("vendor_key", F.regexp_replace("legal_name", "Supplier#0*", "Vendor ").alias("legal_name"), "city")
    none = spark.createDataFrame([], "vendor_key string, code string, is_primary boolean")
    store = writeback.prepare(v, none, f"{step_dir(spark)}/store-{uuid.uuid4().hex}", buckets=8)
    writeback.write_back_codes(store, r, X.view(spark, sf_dir, X.CODES), ranges=2)
    n = store.read("vendor_codes").groupBy("vendor_key").agg(F.count("*").alias("n_codes"))
    done = F.coalesce("naics_enriched", F.lit(False)).alias("naics_enriched")
    return store.read("vendors").join(n, "vendor_key", "left").select("vendor_key", done, "naics_match_count", F.coalesce("n_codes", F.lit(0)).alias("n_codes"))


@query(C + ", d AS (SELECT DISTINCT external_id AS vendor_key, gsin AS code FROM x WHERE gsin <> '') SELECT vendor_key, code, false AS is_primary FROM d WHERE code NOT LIKE 'N1%'")
def bridge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.contract_rows(X.view(spark, sf_dir, X.CONTRACTS)).where("gsin is not null").select(F.col("external_id").alias("vendor_key"), F.col("gsin").alias("code"))
    return ingest.new_bridge_rows(rows.where("code like 'N1%'").distinct(), rows)


@query(C + "SELECT DISTINCT external_id AS vendor_key, contact_email AS email, 60 AS confidence_score FROM x WHERE contact_email <> '' AND contact_email NOT LIKE '%7.com'")
def contact_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.contract_rows(X.view(spark, sf_dir, X.CONTRACTS)).withColumnRenamed("external_id", "vendor_key").where("contact_email is not null")
    stored = rows.where("contact_email like '%7.com'").select("vendor_key", F.col("contact_email").alias("email")).distinct()
    return ingest.new_contacts(stored, rows).select("vendor_key", "email", "confidence_score")


@query("SELECT 's' || l_suppkey AS vendor_name, count(*) AS payment_count, max(strftime(l_shipdate, '%Y-%m-%d')) AS last_payment_date, least(100, count(*)) AS n_payments FROM lineitem GROUP BY l_suppkey")
def payment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("vendor_name"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_orderkey").cast("string").alias("procurement_id"), F.lit(None).cast("string").alias("project_number"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("payment_date"))
    return ingest.payment_rollup(rows).select("vendor_name", "payment_count", "last_payment_date", F.size("payments").cast("long").alias("n_payments"))


@query("SELECT 's' || o_custkey AS external_id, CAST(min(o_orderdate) AS DATE) AS first_contract_date, CAST(max(o_orderdate) AS DATE) AS last_contract_date, CAST(max(o_orderdate) AS DATE) + 365 AS last_expiry_date, count(DISTINCT o_orderpriority) AS n_commodities, count(*) AS agreement_count FROM orders GROUP BY o_custkey")
def standing_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("s"), "o_custkey").alias("external_id"), F.concat(F.lit("s"), "o_custkey").alias("legal_name"), F.lit(None).cast("string").alias("standardized_name"), F.lit("").alias("operating_name"),
        F.col("o_orderpriority").alias("commodity"), day.alias("award_date"), F.date_add(day, 365).alias("expiry_date"), F.col("o_orderkey").cast("string").alias("agreement_number"), F.col("o_orderstatus").alias("agreement_type"), F.lit("").alias("description"),
    )
    out = ingest.standing_offers(rows)
    return out.select("external_id", "first_contract_date", "last_contract_date", "last_expiry_date", F.size("commodities").cast("long").alias("n_commodities"), "agreement_count")


@query("WITH c AS (SELECT DISTINCT o_orderkey // 1000 AS chunk FROM orders) SELECT chunk, count(*) AS n FROM (SELECT o_orderkey // 1000 AS chunk FROM orders) WHERE chunk >= (SELECT count(*) // 2 FROM c) GROUP BY chunk")
def replay_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the chunks that the ledger does not know: the second half."""
    rows = ingest.chunks(table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "ord"), 1000)
    half = rows.agg(F.count_distinct("chunk")).first()[0] // 2
    ledger = ingest.chunk_digests(rows.where(F.col("chunk") < half), "orders").select("source", "digest")
    new, _ = ingest.unseen(rows, ledger, "orders")
    return new.groupBy("chunk").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT 'src' AS source, CAST(user_id AS VARCHAR) AS cache_key, max(ts) AS created_at FROM events GROUP BY user_id) SELECT cache_key, created_at FROM e WHERE created_at + INTERVAL 1 HOUR > (SELECT max(ts) FROM events)")
def fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    entries = e.select(F.lit("src").alias("source"), F.col("user_id").cast("string").alias("cache_key"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 1 hour")).alias("expires_at"))
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast(e.schema["ts"].dataType)
    return ingest.cached(entries, now).select("cache_key", "created_at")


@query("WITH j AS (SELECT *, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS r FROM events), n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY r, ts DESC) AS k FROM j) SELECT user_id, event_id FROM n WHERE k = 1")
def job_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed").otherwise("other")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"), F.col("ts").alias("started_at"))
    return sinks.pick_job(rows, "user_id").select("user_id", "event_id")


# contacts

_MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_BAD = "(regexp_matches(lower(e), '^(test|noreply|donotreply|no-reply|bounce|mailer|webmaster|abuse|postmaster)@') OR list_contains(['example.com','example.org','test.com','localhost','domain.com','email.com','mail.com'], lower(string_split(e, '@')[-1])))"


@query(f"SELECT doc_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '{_MAIL}', 0, 'i'), lambda e: NOT {_BAD}), lambda e: lower(e)))) AS n_emails, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '{_MAIL}', 0, 'i'), lambda e: NOT {_BAD}), lambda e: lower(e)))), ' ') AS emails FROM documents WHERE text LIKE '%@%'")
def emails_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = contacts.emails(F.col("text"))
    return table(spark, sf_dir, "documents").where("text like '%@%'").select("doc_id", F.size(e).cast("long").alias("n_emails"), F.array_join(F.array_sort(e), " ").alias("emails"))


_PH = [r"\+1[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\(\d{3}\)\s?\d{3}[-.\s]?\d{4}", r"\d{3}[-.\s]\d{3}[-.\s]\d{4}", r"\b\d{3}\.\d{3}\.\d{4}\b"]
_PHS = " || ".join(f"regexp_extract_all(text, '{p}')" for p in _PH)


@query(f"WITH p AS (SELECT doc_id, list_transform({_PHS}, lambda p: regexp_replace(p, '[^0-9]', '', 'g')) AS d FROM documents), q AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(d, lambda x: CASE WHEN length(x) = 10 THEN '+1' || x WHEN length(x) = 11 AND x LIKE '1%' THEN '+' || x END), lambda x: x IS NOT NULL))) AS f FROM p) SELECT doc_id, array_to_string(f, ' ') AS phones FROM q WHERE len(f) > 0")
def phones_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", contacts.phones(F.col("text")).alias("p"))
    return rows.where(F.size("p") > 0).select("doc_id", F.array_join(F.array_sort("p"), " ").alias("phones"))


@query(f"WITH e AS (SELECT doc_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(text, '{_MAIL}', 0, 'i'), lambda e: NOT {_BAD}), lambda e: lower(e)))) AS e, len(list_distinct(list_filter(list_transform({_PHS}, lambda p: regexp_replace(p, '[^0-9]', '', 'g')), lambda x: length(x) = 10 OR (length(x) = 11 AND x LIKE '1%')))) AS p FROM documents) SELECT doc_id, CASE WHEN e > 0 AND p > 0 THEN 0.9 ELSE 0.7 END AS confidence, least(e, 5) AS n_emails FROM e WHERE e > 0 OR p > 0")
def contact_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", contacts.contact_bundle(F.col("text")).alias("b")).where("b.confidence > 0")
    return b.select("doc_id", "b.confidence", F.size("b.emails").cast("long").alias("n_emails"))


@query()
def contact_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", contacts.contact_bundle(F.col("text")).alias("b")).where("b.confidence > 0")
    return b.select("doc_id", F.array_join("b.emails", " ").alias("emails"), F.array_join("b.phones", " ").alias("phones"), "b.confidence")


@query(V + "SELECT ord, CASE WHEN email IS NOT NULL AND phone IS NOT NULL THEN 'complete' WHEN email IS NULL AND phone IS NULL THEN 'missing' ELSE 'partial' END AS status FROM v")
def contact_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vendors(spark, sf_dir).select("ord", contacts.contact_status(F.col("email"), F.col("phone")).alias("status"))


@query(V + """, d AS (SELECT ord, company_name, regexp_replace(lower(coalesce(regexp_extract(website, '^[A-Za-z]+://([^/?#]*)', 1), '')), '^www\\.', '') AS own FROM v),
  k AS (SELECT ord, own, regexp_replace(lower(company_name), '[^a-z0-9]', '', 'g') AS token, CASE WHEN len(string_split(own, '.')) >= 2 THEN list_extract(string_split(own, '.'), -2) ELSE own END AS root FROM d),
  e AS (SELECT ord, own, root, token, unnest(['a@site' || (ord % 300) || '.com', 'b@x.gc.ca', 'c@' || token || '.net', 'd@other.org']) AS email, unnest([1, 2, 3, 4]) AS i FROM k),
  r AS (SELECT *, string_split(email, '@')[-1] AS dom FROM e),
  s AS (SELECT ord, email, i, CASE WHEN own <> '' AND dom LIKE '%' || own THEN 0 WHEN root <> '' AND list_extract(string_split(dom, '.'), -2) = root THEN 1 WHEN token <> '' AND contains(regexp_replace(dom, '[-.]', '', 'g'), token) THEN 1 WHEN dom LIKE '%.gc.ca' THEN NULL ELSE 2 END AS k FROM r)
  SELECT ord, string_agg(email, ' ' ORDER BY i) AS emails FROM (SELECT *, min(k) OVER (PARTITION BY ord) AS best FROM s) WHERE k = best GROUP BY ord""")
def preferred_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vendors(spark, sf_dir)
    found = F.array(F.concat(F.lit("a@site"), F.col("ord") % 300, F.lit(".com")), F.lit("b@x.gc.ca"), F.concat(F.lit("c@"), names.compact(F.col("company_name")), F.lit(".net")), F.lit("d@other.org"))
    return v.select("ord", F.array_join(contacts.vendor_emails(found, F.col("website"), F.col("company_name")), " ").alias("emails"))


@query()
def contact_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers from documents as sites and snippets of vendors."""
    v = X.vendors(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("v"), F.col("doc_id")).alias("vendor_key"), F.col("text").alias("contact_text"))
    guesses = v.where(F.col("ord") % 10 == 0).select("vendor_key", F.lit(2).alias("level"), F.lit("serper_backup").alias("source"), F.lit(0.7).alias("confidence"), F.array(F.concat(F.lit("x@site"), F.col("ord") % 300, F.lit(".com"))).alias("emails"), F.array(F.lit("+16135550100")).alias("phones"))
    out = enrich.contact_ladder(v, enrich.site_candidates(texts).unionByName(guesses))
    return out.select("ord", "email", "email_source", "phone", "phone_source", "contact_status")


# pages and documents


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(pages.readable()(F.col("html"))).alias("n_chars"))


@query()
def site_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of a domain from its pages, in tiers of three."""
    p = table(spark, sf_dir, "pages").select(names.domain(F.col("url")).alias("domain"), (F.col("page_id") % 3 + 1).cast("int").alias("tier"), F.col("page_id").cast("int").alias("ord"), "html", F.when(F.col("page_id") % 50 == 7, 403).otherwise(200).alias("status"))
    return enrich.sites(p).select("domain", F.length("website_content").alias("n_chars"))


S = "WITH s AS (" + X.plain(X.SECTIONS) + ") "
_HEAD = "CASE WHEN lower(title) LIKE '%scope of work%' THEN 'scope_of_work' WHEN lower(title) LIKE '%mandatory requirements%' THEN 'mandatory_requirements' WHEN lower(title) LIKE '%delivery location%' THEN 'location_details' END"


@query(S + f", h AS (SELECT *, CASE WHEN section_type <> 'table' THEN {_HEAD} END AS f FROM s), c AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY tender_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS carried FROM h) SELECT tender_id, carried AS field, md5(string_agg(content, chr(10) || chr(10) ORDER BY ord)) AS digest FROM c WHERE section_type <> 'table' AND carried IS NOT NULL GROUP BY 1, 2")
def heading_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.field_texts(sections.with_field(X.view(spark, sf_dir, X.SECTIONS)))
    return out.select("tender_id", "field", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(S + ", b AS (SELECT tender_id, ord, sum(length(content)) OVER (PARTITION BY tender_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM s) SELECT tender_id, ord FROM b WHERE used <= 1500")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.budget_prefix(X.view(spark, sf_dir, X.SECTIONS), ["tender_id"], ["ord"], "content", 1500).select("tender_id", "ord")


_GOLD = " OR ".join(f"contains(t, '{w}')" for w in documents.GOLD)
_JUNK = " OR ".join(f"contains(t, '{w}')" for w in documents.JUNK)


@query(S + f", t AS (SELECT tender_id, ord, lower(title) || ' ' || lower(substr(content, 1, 200)) AS t FROM s) SELECT tender_id, ord, CASE WHEN {_GOLD} THEN 'gold' WHEN {_JUNK} THEN 'junk' ELSE 'neutral' END AS class FROM t")
def section_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.view(spark, sf_dir, X.SECTIONS).select("tender_id", "ord", documents.section_class(F.col("title"), F.col("content")).alias("class"))


@query()
def smart_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.smart_context(X.view(spark, sf_dir, X.SECTIONS)).select("tender_id", F.length("context").alias("n_chars"))


@query()
def structured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field that patterns find in a tender's sections."""
    out = sections.structured(sections.wide(sections.with_field(X.view(spark, sf_dir, X.SECTIONS))))
    return out.select("tender_id", "project_type", "sector", "location.city", "vendor_requirements.lead_days", "identifiers.solicitation", "contact.email", "terms.term_years", F.size("volumes").alias("n_volumes"), F.size("naics_codes").alias("n_codes"))


_SECTORS = {"alpha": ["the and", "tion the"], "beta": ["der ", "und "], "gamma": ["que ", "les "]}
_VOTES = ", ".join(f"{' + '.join(f'CAST(contains(t, {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in ws)} AS {k}" for k, ws in _SECTORS.items())


@query(f"WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), c AS (SELECT doc_id, {_VOTES} FROM l) SELECT doc_id, CASE WHEN greatest(alpha, beta, gamma) = 0 THEN 'general' WHEN alpha = greatest(alpha, beta, gamma) THEN 'alpha' WHEN beta = greatest(alpha, beta, gamma) THEN 'beta' ELSE 'gamma' END AS sector FROM c")
def sector_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", documents.sector(F.col("text"), _SECTORS).alias("sector"))


_NAME = "CASE p_partkey % 6 WHEN 0 THEN 'Addendum #' || (p_partkey % 9) || '.pdf' WHEN 1 THEN 'RFP ' || p_name || '.pdf' WHEN 2 THEN 'appendix b.pdf' WHEN 3 THEN 'Amendment no. 2 spec.pdf' WHEN 4 THEN 'Terms.pdf' ELSE p_name || '.pdf' END"


@query(f"WITH n AS (SELECT p_partkey, lower({_NAME}) AS n, p_partkey * 5000 AS size FROM part), t AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'addendum' WHEN 1 THEN 'core_rfp' WHEN 2 THEN 'appendix' WHEN 3 THEN 'tech_amendment' WHEN 4 THEN 'legal' ELSE 'other' END AS kind FROM n) SELECT p_partkey, kind, CASE kind WHEN 'addendum' THEN 600 + 10 * (p_partkey % 9) WHEN 'core_rfp' THEN 1000 WHEN 'appendix' THEN 700 WHEN 'tech_amendment' THEN 920 WHEN 'legal' THEN 300 ELSE 100 END + least(size / 1000000.0 * 50, 200.0) AS priority FROM t")
def document_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 6 == 0, F.concat(F.lit("Addendum #"), k % 9, F.lit(".pdf"))).when(k % 6 == 1, F.concat(F.lit("RFP "), p, F.lit(".pdf"))).when(k % 6 == 2, F.lit("appendix b.pdf")).when(k % 6 == 3, F.lit("Amendment no. 2 spec.pdf"))
    name = name.when(k % 6 == 4, F.lit("Terms.pdf")).otherwise(F.concat(p, F.lit(".pdf")))
    kind = documents.document_type(name, F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), documents.document_number(name).alias("n"), (k * 5000).alias("size"))
    return rows.select("p_partkey", "kind", documents.document_priority(F.col("kind"), F.col("n"), F.col("size")).alias("priority"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'line_items' WHEN 1 THEN 'qa' WHEN 2 THEN 'technical_specs' WHEN 3 THEN 'pricing' ELSE 'unknown' END AS kind FROM part")
def table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    header = F.when(k == 0, "| Line Item No | Description |").when(k == 1, "| Question | Answer |").when(k == 2, "| Characteristic | Value |").when(k == 3, "| Name | Unit price |").otherwise("| Size | Colour |")
    content = F.concat(header, F.lit("\n| --- | --- |\n| "), "p_size", F.lit(" | "), "p_name", F.lit(" |"))
    return table(spark, sf_dir, "part").select("p_partkey", documents.table_type(content).alias("kind"))


@query("SELECT p_partkey, 0 AS place, '#' || p_partkey || ' - ' || p_name AS item, CAST(p_size AS DOUBLE) AS quantity, 'box' AS unit FROM part")
def table_line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("| Item No | Description | Qty | Unit |\n|---|---|---|---|\n| "), "p_partkey", F.lit(" | "), "p_name", F.lit(" | 1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" pcs | box |\n| short | row |"))
    rows = table(spark, sf_dir, "part").select("p_partkey", content.alias("content"))
    return sections.extract_line_items(rows, ("p_partkey",)).withColumn("quantity", F.col("quantity") - 1000)


@query("SELECT p_partkey, 'Table ' || p_partkey || ' [' || p_name || '] from a.pdf: ' || (p_size % 4) || ' data rows, columns: | Item | Qty |' AS summary FROM part")
def table_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("intro\n| Item | Qty |\n| --- | --- |"), F.repeat(F.lit("\n| a | 1 |"), F.col("p_size") % 4))
    return table(spark, sf_dir, "part").select("p_partkey", documents.table_summary(F.col("p_partkey"), F.col("p_name"), F.lit("a.pdf"), content).alias("summary"))


# registry rows and captured facts


@query(R + "SELECT vendor_key, (CASE WHEN total_contract_value > 10000000 THEN 'high_value_supplier ' ELSE '' END) || (CASE WHEN contract_count > 600 THEN 'frequent_supplier' ELSE '' END) AS flags FROM r")
def vendor_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.view(spark, sf_dir, X.REGISTRY)
    f = names.flags(F.col("total_contract_value"), F.col("contract_count"), 10_000_000, 600)
    return r.select("vendor_key", F.concat(F.when(F.array_contains(f, "high_value_supplier"), "high_value_supplier ").otherwise(""), F.when(F.array_contains(f, "frequent_supplier"), "frequent_supplier").otherwise("")).alias("flags"))


@query(R + "SELECT vendor_key, legal_name AS company_name, city || ', ' || state AS location, 'c' || vendor_key || '@x.com' AS email FROM r WHERE source IN ('canada_contracts', 'canada_odbus')")
def registry_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows as vendors with their first contact."""
    r = X.view(spark, sf_dir, X.REGISTRY).withColumns({"website": F.lit(None).cast("string"), "country": F.lit(None).cast("string"), "business_types": F.array().cast("array<string>")})
    people = r.select("vendor_key", F.explode(F.array(F.lit(2), F.lit(1))).alias("contact_id"), F.lit("A").alias("first_name"), F.lit(None).cast("string").alias("last_name"), F.lit(None).cast("string").alias("phone"))
    people = people.withColumn("email", F.when(F.col("contact_id") == 1, F.concat(F.lit("c"), "vendor_key", F.lit("@x.com"))).otherwise("later@x.com"))
    return registry.to_vendor(registry.search(r), registry.first_contact(people)).select("vendor_key", "company_name", "location", "email")


@query(V + "SELECT ord, CASE WHEN uei IS NOT NULL AND ord % 22 = 0 THEN uei WHEN cage_code IS NOT NULL THEN cage_code ELSE NULL END AS entity_id FROM v")
def identifier_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of a vendor by uei, else by cage code, else by name: here half of the ueis and all cage codes are known."""
    v = X.vendors(spark, sf_dir)
    known = lambda c, test: v.where(f"{c} is not null and {test}").select(F.col(c).alias("entity_id")).distinct()
    u, c = known("uei", "ord % 22 = 0"), known("cage_code", "true")
    none = F.lit(None).cast("string")
    row = lambda df, uei, cage: df.select("entity_id", uei.alias("uei"), cage.alias("cage_code"), none.alias("legal_name"), none.alias("email"), none.alias("phone"))
    entities = row(u, F.col("entity_id"), none).unionByName(row(c, none, F.col("entity_id")))
    own = v.withColumn("uei", F.when(F.col("ord") % 22 == 0, F.col("uei")))
    return registry.identifier_cascade(own, entities).select("ord", "entity.entity_id")


@query(V + "SELECT ord, coalesce(email, 'x' || ord || '@y.z') AS email, CASE WHEN ord % 2 = 0 THEN '+100' ELSE phone END AS phone, CASE WHEN ord % 2 = 0 AND phone IS DISTINCT FROM '+100' THEN 1 ELSE 0 END AS n_changes FROM v")
def facts_and_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured addresses where a vendor has none, then manual numbers with a list of changes."""
    v = X.vendors(spark, sf_dir).select("vendor_key", "ord", "email", "phone")
    facts = v.select("vendor_key", F.concat(F.lit("x"), "ord", F.lit("@y.z")).alias("email"))
    manual = v.where("ord % 2 = 0").select("vendor_key", F.lit("+100").alias("phone"))
    out = enrich.override(enrich.fill_if_empty(v, facts, ["email"]), manual, "vendor_key", ["phone"])
    return out.select("ord", "email", "phone", F.size("changes").alias("n_changes"))


@query(V + "SELECT ord, 'sales@' || d || ' info@' || d AS candidates FROM (SELECT ord, regexp_replace(lower(regexp_extract(website, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS d FROM v WHERE website LIKE '%://%')")
def email_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contacts.email_candidates(F.col("website"), ["sales", "info", "contact"], 2)
    return X.vendors(spark, sf_dir).select("ord", F.array_join(c, " ").alias("candidates")).where("candidates <> ''")


@query("SELECT 'i' || (o_custkey % 50) AS external_id, count(DISTINCT o_orderpriority) AS n_products FROM orders GROUP BY 1")
def importer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("i"), F.col("o_custkey") % 50).alias("external_id"), F.lit("n").alias("name"), F.lit("c").alias("city"), F.lit("p").alias("province"), F.lit("z").alias("postal_code"), F.col("o_orderpriority").alias("hs_code"), F.lit("d").alias("hs_description"))
    return ingest.importer_rollup(rows).select("external_id", F.size("products").cast("long").alias("n_products"))


@query("SELECT 's' || o_custkey AS external_id, coalesce(nullif(CAST(sum(CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18, 2)) END) AS DOUBLE), 0), CAST(count(*) * 5 AS DOUBLE)) AS total_contract_value FROM orders GROUP BY o_custkey")
def award_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of values or, where there are none, of amounts."""
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    cols = {c: none for c in ("standardized_name", "address", "city", "state", "postal_code", "employee_count_range", "gsin", "unspsc", "contact_name", "contact_email", "contact_phone", "contract_number", "description", "category")}
    rows = o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("s"), "o_custkey").alias("external_id"), F.concat(F.lit("s"), "o_custkey").alias("legal_name"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(38,6)")).alias("value"), F.lit(5).cast("decimal(38,6)").alias("amount"), F.col("o_orderdate").cast("date").alias("date")).withColumns(cols)
    return ingest.award_rollup(rows).select("external_id", "total_contract_value")


# similarity and search terms

_W = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}') AND NOT list_contains(['a','an','and','or','the','for','of','in','to','with','by','from'], w))"


@query(f"WITH b AS (SELECT item_id, {_W} AS w FROM benchmark) SELECT x.item_id AS a, y.item_id AS b, round(CASE WHEN len(x.w) = 0 OR len(y.w) = 0 THEN 0 ELSE len(list_intersect(x.w, y.w)) * 1.0 / len(list_distinct(x.w || y.w)) END, 9) AS jaccard FROM b x JOIN b y ON x.item_id + 1 = y.item_id")
def query_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", similarity.content_words(F.col("text")).alias("w"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("w").alias("w2"))
    return b.join(other, "item_id").select(F.col("item_id").alias("a"), "b", F.round(similarity.jaccard(F.col("w"), F.col("w2")), 9).alias("jaccard"))


@query(f"SELECT item_id, len({_W}) + CASE WHEN regexp_matches(lower(text), 'oem|manufacturer|producer|maker|fabricator') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'distributor|wholesaler|installer|integrator|consultant|service|maintenance') THEN 1 ELSE 0 END AS specificity FROM benchmark")
def query_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", similarity.specificity(F.col("text")).cast("long").alias("specificity"))


@query("WITH t AS (SELECT DISTINCT p_name AS term FROM part), q AS (SELECT term || ' Boston' AS query, 0 AS level FROM t UNION ALL SELECT term || ' Massachusetts', 1 FROM t UNION ALL SELECT term, 2 FROM t) SELECT query, level FROM q WHERE lower(query) NOT IN (SELECT lower(p_name) FROM part WHERE p_name LIKE 'red%')")
def geo_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    terms = p.groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("ord"))
    executed = p.where("p_name like 'red%'").select(F.col("p_name").alias("query"))
    return discovery.geo_queries(terms, [("city", "Boston"), ("region", "Massachusetts"), ("global", None)], executed).select("query", "level")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') ORDER BY page_id) AS k FROM pages WHERE NOT regexp_matches(lower(regexp_replace(url, '[?#].*', '')), '^[a-z]+://[^/]*.*(/blog|/news|/article|/insight|/stories)')) WHERE k = 1")
def discovered_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("level"), F.lit("q").alias("query"), F.col("page_id").alias("position"), F.lit("Home").alias("title"), F.lit("").alias("snippet"), names.domain(F.col("url")).alias("domain"), "url")
    return discovery.candidates(rows).select("page_id", "domain")


# streams: the same result as the batch


@query("SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return resolve.first_by_key(rows, F.col("user_id"), "event_id")


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: rows per user and day, by the window that the stream uses."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = e.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query()
def streamed_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors through a file stream: unique by key, scored, written per batch, and read again."""
    import uuid

    from .session import step_dir
    from .streaming import flows

    root = f"{step_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = X.vendors(spark, sf_dir)
    rows.repartition(4, "ord").write.parquet(f"{root}/in")
    stream = flows.read_stream(spark, f"{root}/in", rows.schema)
    unique = flows.unique_stream(stream, names.stream_key(F.col("uei"), F.col("duns"), F.lit(None).cast("string"), F.col("company_name")))
    done = flows.enrich_stream(unique, lambda b: b.withColumn("website_content", F.col("website")), lambda b: filtering.match_rows(b, TENDER), f"{root}/out", f"{root}/checkpoint")
    done.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("vendor_key").agg(F.count("*").alias("n"))


@query()
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ranked vendors until enough are relevant: the rows that were scored."""
    from .plans import batches

    order = [F.col("total_contract_value").desc_nulls_last(), F.col("ord")]
    from pyspark.sql import Window

    top = X.vendors(spark, sf_dir).orderBy(*order).limit(500)
    placed = checkpointed(top.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1))
    content = lambda b: b.withColumn("website_content", F.col("website")).withColumn("scrape_error", F.lit(None).cast("string"))
    score = lambda b: filtering.match_rows(b.withColumn("scorer_response", F.concat(F.lit('{"score": '), F.col("ord") % 100, F.lit("}"))), TENDER)
    done = batches.run_gated(placed, content, score)
    return sections.union_texts(done.scored).select("ord", "place", "capability_match_score", "match_status")


_REQUESTS = """SELECT concat('v', user_id) AS vendor_key, ts AS asked, CASE WHEN user_id % 29 = 3 THEN concat('own', user_id, '.com') END AS website,
  CASE WHEN event_type = 'error' THEN 202 WHEN event_id % 11 = 5 THEN 403 ELSE 200 END AS first_status, CASE WHEN event_id % 3 <> 0 THEN concat('f', event_id, '.com') END AS first_website,
  CASE WHEN event_id % 5 = 0 THEN 0.25 ELSE 0.75 END AS first_confidence, CASE WHEN event_id % 4 = 1 THEN concat('s', event_id, '.com') END AS second_website, CAST(user_id % 50 AS INT) AS searcher FROM {events}"""

LADDER_SQL = "WITH RECURSIVE r AS (" + X.plain(_REQUESTS) + """),
e AS (SELECT *, epoch_us(asked) AS t, row_number() OVER (PARTITION BY searcher ORDER BY asked, vendor_key) AS n, CASE WHEN first_status = 200 AND first_website IS NOT NULL AND first_confidence >= 0.5 THEN first_website END AS good FROM r),
walk AS (SELECT DISTINCT searcher, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS banned, MAP {'': {'until': CAST(0 AS BIGINT), 'site': CAST(NULL AS VARCHAR), 'sure': CAST(NULL AS DOUBLE)}} AS known,
         CAST(NULL AS VARCHAR) AS vendor_key, CAST(NULL AS TIMESTAMP) AS asked, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS website, CAST(NULL AS DOUBLE) AS confidence, false AS skipped FROM e
  UNION ALL SELECT searcher, n, CASE WHEN lvl IN ('first', 'second', 'none') AND NOT skp AND first_status = 202 THEN t + 300000000 ELSE banned END,
         CASE WHEN lvl IN ('first', 'second', 'none') THEN map_concat(known, MAP {vendor_key: {'until': t + 604800000000, 'site': found, 'sure': sure}}) ELSE known END, vendor_key, asked, lvl, found, sure, skp FROM (
    SELECT e.*, w.banned, w.known, w.known[e.vendor_key] AS hit, e.website IS NULL AND NOT coalesce(hit['until'] > e.t, false) AND e.t < w.banned AS skp,
           CASE WHEN e.website IS NOT NULL THEN 'given' WHEN hit['until'] > e.t THEN CASE WHEN hit['site'] IS NULL THEN 'negative' ELSE 'cache' END WHEN NOT skp AND e.good IS NOT NULL THEN 'first' WHEN e.second_website IS NOT NULL THEN 'second' ELSE 'none' END AS lvl,
           CASE lvl WHEN 'given' THEN e.website WHEN 'cache' THEN hit['site'] WHEN 'first' THEN e.good WHEN 'second' THEN e.second_website END AS found,
           CASE lvl WHEN 'cache' THEN hit['sure'] WHEN 'first' THEN CAST(e.first_confidence AS DOUBLE) WHEN 'second' THEN 0.9::DOUBLE END AS sure
    FROM e JOIN walk w ON w.searcher = e.searcher AND e.n = w.n + 1))
SELECT searcher, vendor_key, epoch_us(asked) AS asked, level, website, confidence, skipped FROM walk WHERE n > 0"""


@query(LADDER_SQL)
def website_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Websites asked for over time, by searchers that are refused now and then and remember for a week what they found or did not."""
    from .streaming import flows, ladder

    root = f"{step_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = X.view(spark, sf_dir, _REQUESTS).withColumn("asked", F.col("asked").cast("timestamp")).withColumnRenamed("asked", "at").withColumn("first_confidence", F.col("first_confidence").cast("double"))
    rows.write.parquet(f"{root}/in")
    before = spark.conf.get(ladder.STATE_STORE, None)
    spark.conf.set(ladder.STATE_STORE, ladder.ROCKS)
    try:
        stream = flows.read_stream(spark, f"{root}/in", rows.schema, files_per_batch=1_000_000)
        found = ladder.website_ladder(stream, searcher=F.col("searcher"))
        found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ladder.STATE_STORE, before) if before else spark.conf.unset(ladder.STATE_STORE)
    return spark.read.parquet(f"{root}/out").withColumn("at", F.unix_micros("at")).withColumnRenamed("at", "asked")

from . import catalog_feeds  # noqa: E402, F401 - adds its queries
