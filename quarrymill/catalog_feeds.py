"""Registered queries over feeds: the driver's tables written as a feed is delivered (CSV with its headers, JSON), read by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .catalog import _REASON, _SCORE, _TIER, ORACLE_SQL, TENDER, C, V, query, table
from .functions import cleaning
from .operators import enrich, filtering, ingest, registry, sections
from .operators.filtering import FilterConfig
from .plans import tender as plans
from .session import step_dir
from .sources import feeds


def _folder(spark: SparkSession) -> str:
    return f"{step_dir(spark)}/feed-{uuid.uuid4().hex}"


def _csv(spark: SparkSession, df: DataFrame, headers: dict[str, str] | None = None) -> str:
    """The path of df as a CSV feed, its columns under the feed's headers."""
    path = _folder(spark)
    names = headers or {}
    df.select(*[F.col(f"`{c}`").cast("string").alias(names.get(c, c)) for c in df.columns]).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


def _json(spark: SparkSession, df: DataFrame, root: str) -> DataFrame:
    """Payloads of a service that hold df's rows in lists under `root`: a payload per thousand rows or so, so that no list grows with the table."""
    path = _folder(spark)
    listed = df.withColumn("_page", F.pmod(F.xxhash64(*df.columns), F.lit(max(1, df.count() // 1000)))).groupBy("_page").agg(F.collect_list(F.struct(*df.columns)).alias(root)).drop("_page")
    listed.write.json(path)
    return spark.read.schema(listed.schema).json(path)


def _list(c: Column | str) -> Column:
    return F.array_join(c, "/")


@query(C + "SELECT external_id, contract_number, CAST(amount AS DECIMAL(18, 2)) AS value, day AS date, nullif(gsin, '') AS gsin, nullif(contact_email, '') AS contact_email FROM x")
def feed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = X.view(spark, sf_dir, X.CONTRACTS)
    feed = feeds.route(spark, "canada_contracts", _csv(spark, view.drop("ord"), feeds.CONTRACTS))
    return ingest.contract_rows(feed).select("external_id", "contract_number", F.col("value").cast("decimal(18, 2)").alias("value"), "date", "gsin", "contact_email")


_AWARDS = """SELECT concat('Winner ', l_suppkey) AS legal_name, CASE WHEN l_partkey % 3 = 0 THEN '0' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING) END AS value,
  CAST(CAST(l_extendedprice / 2 AS DECIMAL(18, 2)) AS STRING) AS amount, concat('N', l_partkey % 7, {newline}, ' N', l_partkey % 5, ' ') AS gsin, concat('R', l_orderkey, '-', l_linenumber) AS reference FROM {{lineitem}}"""


@query("WITH x AS (" + X.plain(_AWARDS.format(newline="chr(10)")) + "), c AS (SELECT DISTINCT legal_name, trim(unnest(string_split(gsin, chr(10)))) AS code FROM x) SELECT legal_name, CAST(coalesce(nullif(sum(CAST(value AS DECIMAL(18, 2))), 0), sum(CAST(amount AS DECIMAL(18, 2)))) AS DECIMAL(18, 2)) AS total, count(*) AS n, (SELECT count(*) FROM c WHERE c.legal_name = x.legal_name) AS codes FROM x GROUP BY legal_name")
def feed_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = X.view(spark, sf_dir, _AWARDS.format(newline="char(10)"))
    feed = feeds.route(spark, "canada_award_notices", _csv(spark, view, feeds.AWARDS))
    rows = ingest.contract_rows(feed).join(feed.select("ord", cleaning.decimal(F.col("amount")).alias("amount")), "ord")
    codes = ingest.split_codes(rows).groupBy("external_id").agg(F.count("*").alias("codes"))
    return ingest.award_rollup(rows).join(codes, "external_id").select("legal_name", F.col("total_contract_value").cast("decimal(18, 2)").alias("total"), F.col("contract_count").alias("n"), "codes")


_OFFERS = """SELECT CASE WHEN o_custkey % 13 = 0 THEN '' ELSE concat('Offerer "', o_custkey % 60, '", Inc') END AS legal_name, concat('C', o_custkey % 7) AS commodity, concat('A', o_orderkey) AS agreement_number,
  CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) END AS award_date, concat(CAST(2000 + o_orderkey % 30 AS STRING), '-01-05T00:00') AS expiry_date FROM {orders}"""


@query("WITH x AS (" + X.plain(_OFFERS) + ") SELECT legal_name, legal_name || '_NO_POSTAL' AS external_id, agreement_number, commodity, try_cast(award_date AS DATE) AS award_date, CAST(substr(expiry_date, 1, 4) || '-01-05' AS DATE) AS expiry_date FROM x WHERE legal_name <> ''")
def feed_standing_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.standing_offers(spark, _csv(spark, X.view(spark, sf_dir, _OFFERS), feeds.STANDING_OFFERS))
    return feed.select("legal_name", "external_id", "agreement_number", "commodity", "award_date", "expiry_date")


_PAID = "SELECT CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE concat('Payee ', l_suppkey) END AS vendor_name, concat('P', l_orderkey) AS procurement_id, CASE WHEN l_linenumber > 5 THEN '' ELSE substr(CAST(l_shipdate AS STRING), 1, 10) END AS payment_date FROM {lineitem}"


@query("WITH x AS (" + X.plain(_PAID) + ") SELECT vendor_name, count(*) AS payment_count, max(nullif(payment_date, '')) AS last_payment_date FROM x WHERE vendor_name <> '' GROUP BY vendor_name")
def feed_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.route(spark, "canada_pspc_payments", _csv(spark, X.view(spark, sf_dir, _PAID), feeds.PAYMENTS))
    return ingest.payment_rollup(feed).select("vendor_name", "payment_count", "last_payment_date")


_BUSINESS = """SELECT concat('Firm ', c_custkey % 500) AS business_name, CASE WHEN c_custkey % 500 % 9 = 4 THEN '..' ELSE concat('City ', c_custkey % 500 % 7) END AS city, CASE WHEN c_custkey % 500 % 3 = 0 THEN '' ELSE concat('k1a ', c_custkey % 5, 'b1') END AS postal_code,
  concat(200 + c_custkey % 500, '.0') AS derived_NAICS, '..' AS source_NAICS_primary, concat(300 + c_custkey % 500 % 2 * (c_custkey % 500 - 100)) AS source_NAICS_secondary FROM {customer}"""


@query("WITH x AS (" + X.plain(_BUSINESS) + """), y AS (SELECT *, nullif(upper(replace(postal_code, ' ', '')), '') AS postal FROM x WHERE city <> '..')
SELECT DISTINCT upper(business_name || '_' || coalesce(postal, city) || '_ODBUS') AS external_id, city, postal AS postal_code, array_to_string(list_distinct([replace(derived_NAICS, '.0', ''), source_NAICS_secondary])[1:0] || CASE WHEN replace(derived_NAICS, '.0', '') = source_NAICS_secondary THEN [source_NAICS_secondary] ELSE [replace(derived_NAICS, '.0', ''), source_NAICS_secondary] END, '/') AS codes FROM y""")
def feed_business_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.business_registry(spark, _csv(spark, X.view(spark, sf_dir, _BUSINESS)))
    return feed.select("external_id", "city", "postal_code", _list("naics_codes").alias("codes"))


_SAM = """SELECT concat('U', s_suppkey) AS `UNIQUE ENTITY ID`, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name END AS `LEGAL BUSINESS NAME`, concat('City ', s_nationkey) AS `PHYSICAL ADDRESS CITY`, CASE WHEN s_suppkey % 2 = 0 THEN 'TX' ELSE '' END AS `PHYSICAL ADDRESS PROVINCE OR STATE`,
  'NM' AS `PHYSICAL ADDRESS STATE`, concat('A', s_suppkey % 3, '~ ~2X~') AS `BUSINESS TYPES`, concat(s_suppkey % 90, '~111') AS `NAICS CODES`, CASE s_suppkey % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' ELSE '' END AS `SMALL BUSINESS` FROM {supplier}"""


@query("SELECT 'U' || s_suppkey AS uei, s_name AS legal_name, CASE WHEN s_suppkey % 2 = 0 THEN 'TX' ELSE 'NM' END AS state, 'A' || (s_suppkey % 3) || '/2X' AS types, (s_suppkey % 90) || '/111' AS codes, s_suppkey % 4 < 2 AS is_small FROM supplier WHERE s_suppkey % 10 <> 0")
def feed_sam_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.route(spark, "sam_csv", _csv(spark, X.view(spark, sf_dir, _SAM)))
    return feed.select("uei", "legal_name", "state", _list("business_types").alias("types"), _list("naics_codes").alias("codes"), "is_small")


_IMPORTS = "SELECT concat('Importer ', c_custkey % 90) AS `Importer Name`, concat('City ', c_custkey % 90 % 4) AS City, 'ON' AS Province, concat('HS', c_custkey % 11) AS `HS Code`, concat('Goods ', c_custkey % 11) AS `HS Description` FROM {customer}"


@query("SELECT DISTINCT 'cid_Importer ' || (c_custkey % 90) || '_City ' || (c_custkey % 90 % 4) AS external_id, 'Importer ' || (c_custkey % 90) AS name, (SELECT string_agg(DISTINCT 'HS' || (b.c_custkey % 11), '/' ORDER BY 'HS' || (b.c_custkey % 11)) FROM customer b WHERE b.c_custkey % 90 = a.c_custkey % 90) AS products FROM customer a")
def feed_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = ingest.importer_rollup(feeds.route(spark, "cid", _csv(spark, X.view(spark, sf_dir, _IMPORTS))))
    return feed.select("external_id", "name", _list(F.transform("products", lambda p: p["hs_code"])).alias("products"))


_CAPABLE = "SELECT s_name AS `Company Name`, concat('City ', s_nationkey) AS City, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat(s_suppkey % 70, ' - Roads, ', 100 + s_suppkey % 9, '-Rail,') END AS NAICS FROM {supplier}"


@query("SELECT 'ccc_' || s_name || '_City ' || s_nationkey AS external_id, s_name AS legal_name, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE (s_suppkey % 70) || '/' || (100 + s_suppkey % 9) END AS codes FROM supplier")
def feed_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.route(spark, "ccc", _csv(spark, X.view(spark, sf_dir, _CAPABLE)))
    return feed.select("external_id", "legal_name", _list("naics_codes").alias("codes"))


_TENDERS = """SELECT concat(' T', o_orderkey, ' ') AS reference, o_orderstatus AS title, CASE o_orderkey % 3 WHEN 0 THEN concat('*N', o_orderkey % 9, '\\n*N1') WHEN 1 THEN concat('N', o_orderkey % 9, ', N2') ELSE '' END AS gsin,
  CASE o_orderkey % 2 WHEN 0 THEN 'Ottawa, Ontario' ELSE 'Alberta' END AS regions, concat(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10), 'T12:00:00') AS posted,
  CASE WHEN o_orderkey % 4 = 0 THEN 'https://a.ca/x.pdf;ftp://no;http://b.ca' WHEN o_orderkey % 4 = 1 THEN 'https://a.ca' ELSE '' END AS attachments, CASE WHEN o_orderkey % 5 = 0 THEN 'https://a.ca' ELSE '' END AS notice_url FROM {orders}"""


@query("""SELECT 'T' || o_orderkey AS external_id, o_orderstatus AS title, CASE o_orderkey % 3 WHEN 0 THEN 'N' || (o_orderkey % 9) || '/N1' WHEN 1 THEN 'N' || (o_orderkey % 9) || '/N2' ELSE '' END AS gsin, CASE WHEN o_orderkey % 2 = 0 THEN 'Ottawa' END AS city,
CASE WHEN o_orderkey % 2 = 0 THEN 'Ontario' ELSE 'Alberta' END AS state, strftime(o_orderdate, '%Y-%m-%d') AS posted,
CASE WHEN o_orderkey % 4 = 0 THEN 'https://a.ca/x.pdf/http://b.ca' || CASE WHEN o_orderkey % 5 = 0 THEN '/https://a.ca' ELSE '' END WHEN o_orderkey % 4 = 1 OR o_orderkey % 5 = 0 THEN 'https://a.ca' ELSE '' END AS attachments FROM orders""")
def feed_open_tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = feeds.open_tenders(spark, _csv(spark, X.view(spark, sf_dir, _TENDERS), feeds.TENDERS))
    return feed.select("external_id", "title", _list("gsin").alias("gsin"), F.col("place.city").alias("city"), F.col("place.state_province").alias("state"), "posted", _list("attachments").alias("attachments"))


@query("SELECT 'S' || o_orderkey AS external_id, o_orderstatus AS title, CAST(o_custkey % 900 AS VARCHAR) AS naics, 'DEPT/' || o_orderpriority AS buyer, strftime(o_orderdate, '%Y-%m-%d') AS posted, CASE WHEN o_orderkey % 3 = 0 THEN 'SBA' END AS set_aside, round(o_totalprice, 2) AS value FROM orders")
def sam_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = lambda c: F.lit(c).cast("string")
    rows = o.select(
        F.concat(F.lit("S"), "o_orderkey").alias("solicitationNumber"), F.col("o_orderstatus").alias("title"), text(None).alias("description"), (F.col("o_custkey") % 900).cast("string").alias("naicsCode"), text("X").alias("classificationCode"),
        F.concat(F.lit("DEPT >> "), "o_orderpriority").alias("fullParentPathName"), text("no").alias("organizationName"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("postedDate"), text("2025-01-01T00").alias("responseDeadLine"),
        F.when(F.col("o_orderkey") % 3 == 0, "SBA").alias("setAsideCode"), text(None).alias("setAside"), F.round(F.col("o_totalprice").cast("double"), 2).cast("string").alias("baseAndAllOptionsValue"), F.array(text("https://x")).alias("resourceLinks"),
    )
    out = feeds.sam_opportunities(_json(spark, rows, "opportunitiesData"))
    return out.select("external_id", "title", _list("naics").alias("naics"), _list("buyer_path").alias("buyer"), "posted", "set_aside", F.round("estimated_value", 2).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'own.com' WHEN c_custkey % 4 = 1 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 THEN 'new' || c_custkey || '.com' END AS website, c_custkey % 4 <> 0 AND (c_custkey % 4 > 1 OR c_custkey % 3 = 0) AND c_custkey % 6 <> 5 AS searched FROM customer")
def cached_websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors with what a cache still knows, found or not, and which of them must be searched for."""
    k = F.col("c_custkey")
    v = table(spark, sf_dir, "customer").select("c_custkey", k.cast("string").alias("vendor_key"), F.when(k % 4 == 0, "own.com").alias("website"), F.when(k % 6 != 5, "City").alias("city"), F.lit("US").alias("country"))
    hours = lambda h: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.lit(h))
    at = lambda rows, made, end, site: rows.select("vendor_key", hours(made).alias("created_at"), hours(end).alias("expires_at"), site.cast("string").alias("website"))
    mine = v.where(k % 4 == 1)
    cache = at(mine, 1, 99, F.lit("old.com")).unionByName(at(mine.where(k % 3 != 0), 2, 48, F.when(k % 7 != 0, F.concat(F.lit("new"), k, F.lit(".com"))))).unionByName(at(mine.where(k % 3 == 0), 3, 4, F.lit("gone.com")))
    out, open_ones = enrich.with_websites_cached(v, cache, hours(10))
    return out.join(open_ones.select("vendor_key", F.lit(True).alias("searched")), "vendor_key", "left").select("c_custkey", "website", F.coalesce("searched", F.lit(False)).alias("searched"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) % 7 <= 3 AS is_expired, epoch(TIMESTAMP '2024-01-20') - floor(epoch(ts)) <= 864000 AS is_fresh FROM events")
def cache_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a cache that have expired, and files that are young enough."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    e = e.withColumn("expires_at", F.timestamp_seconds(F.floor(F.unix_micros("created_at") / 1e6) % 7))
    now = F.timestamp_seconds(F.lit(3))
    old = e.join(ingest.expired(e, now).select("event_id"), "event_id", "left_semi").select("event_id", F.lit(True).alias("is_expired"))
    fresh = ingest.fresh_files(e, F.lit("2024-01-20").cast("timestamp"), 864_000).select("event_id", F.lit(True).alias("is_fresh"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return e.select("event_id").join(old, "event_id", "left").join(fresh, "event_id", "left").select("event_id", no("is_expired"), no("is_fresh"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'A' || (p_partkey % 5) || '/B1/C' ELSE 'B1/C' END AS codes FROM part")
def merged_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, F.array(F.concat(F.lit("A"), k % 5), F.lit(" "))).alias("a"), F.array(F.lit("B1"), F.lit("C")).alias("b"), F.array(F.lit("C"), F.lit("B1"), F.lit("")).alias("c"))
    return rows.select("p_partkey", _list(plans.merged_codes("a", "b", "c")).alias("codes"))


@query(V + f", s AS (SELECT ord, company_name, {_SCORE} + CASE WHEN state = 'MA' THEN 20 WHEN state IN ('CT', 'NH', 'NY', 'RI', 'VT') THEN 10 ELSE 0 END AS total, {_TIER} AS tier FROM v WHERE {_REASON} IS NULL), r AS (SELECT ord, tier, total, row_number() OVER (ORDER BY total DESC, company_name DESC, CASE tier WHEN 'local' THEN 0 WHEN 'regional' THEN 1 ELSE 2 END, ord) AS place FROM s) SELECT ord, total, tier AS geo_tier, CAST(place AS INTEGER) AS place FROM r WHERE place <= 500")
def rerun_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored run for another tender, taken up again with this one's values."""
    from dataclasses import asdict, replace

    from .plans import rerun
    from .sources.store import Store

    config = FilterConfig(duplicates=False, sort_by_distance=True)
    store = Store(spark, _folder(spark))
    rerun.first_run(store, X.vendors(spark, sf_dir), replace(TENDER, state="Ontario", city="Ottawa", country="Canada", set_aside=None, value=10_000.0), config)
    rerun.rerun(store, asdict(TENDER), config)
    return rerun.shortlist(store, config).select("ord", "total", "geo_tier", "place")


_RELEVANT = "CAST(CASE WHEN ord % 100 >= 40 THEN 1 ELSE 0 END AS BIGINT)"


GATE_SQL = V + f""", t AS (SELECT ord, website, row_number() OVER (ORDER BY total_contract_value DESC NULLS LAST, ord) - 1 AS place FROM v QUALIFY place < 500),
b AS (SELECT place // 100 AS batch, count(*) FILTER (WHERE website IS NOT NULL) AS base, sum({_RELEVANT}) FILTER (WHERE website IS NOT NULL) AS good FROM t GROUP BY 1),
g AS (SELECT batch, coalesce(sum(good) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT ord, place, CAST(ord % 100 AS DOUBLE) AS capability_match_score, CASE WHEN ord % 100 >= 40 THEN 'selected' ELSE 'needs_review' END AS match_status FROM t JOIN g ON g.batch = t.place // 100 WHERE before < 50 AND website IS NOT NULL"""
ORACLE_SQL["quality_gate"] = GATE_SQL


@query(GATE_SQL)
def gated_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ranked vendors, two under way at once, until enough are relevant: the rows that were scored. Each batch of the 500 has more than the least share
    of relevant vendors, so the gate closes at the target alone."""
    from pyspark.sql import Window

    from .plans import batches
    from .session import checkpointed

    order = [F.col("total_contract_value").desc_nulls_last(), F.col("ord")]
    top = X.vendors(spark, sf_dir).orderBy(*order).limit(500)
    placed = checkpointed(top.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1))
    content = lambda b: b.withColumn("website_content", F.col("website")).withColumn("scrape_error", F.lit(None).cast("string"))
    score = lambda b: filtering.match_rows(b.withColumn("scorer_response", F.concat(F.lit('{"score": '), F.col("ord") % 100, F.lit("}"))), TENDER)
    done = batches.run_gated_ahead(placed, content, score)
    return sections.union_texts(done.scored).select("ord", "place", F.col("capability_match_score").cast("double").alias("capability_match_score"), "match_status")


@query("WITH r AS (" + X.plain(X.REGISTRY) + "), f AS (SELECT * FROM r WHERE source IN ('canada_contracts', 'canada_odbus') AND state = 'ON'), a AS (SELECT vendor_key, row_number() OVER (ORDER BY total_contract_value DESC NULLS LAST, contract_count DESC NULLS LAST, vendor_key) AS n FROM f), one AS (SELECT vendor_key FROM a WHERE n <= 5), "
       "b AS (SELECT vendor_key, row_number() OVER (ORDER BY total_contract_value DESC NULLS LAST, contract_count DESC NULLS LAST, vendor_key) AS n FROM r WHERE source IN ('canada_contracts', 'canada_odbus')), two AS (SELECT vendor_key FROM b WHERE n <= 12 AND vendor_key NOT IN (SELECT vendor_key FROM one)) SELECT vendor_key, 3 AS arm FROM one UNION ALL SELECT vendor_key, 4 FROM two")  # fmt: skip
def appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a wider search behind those of a narrow one, each vendor once."""
    r = X.view(spark, sf_dir, X.REGISTRY)
    narrow, wide = registry.search(r, province="ON"), registry.search(r)
    return registry.append_new(registry._by_value(narrow.where("state = 'ON'"), 5, 3), registry._by_value(wide, 12, 4), 100).select("vendor_key", "arm")


@query("WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS word FROM part), r AS (SELECT word, row_number() OVER (ORDER BY word) AS r FROM w WHERE length(word) > 3) SELECT a.word || ' ' || b.word AS term FROM r a JOIN r b ON b.r BETWEEN a.r + 1 AND a.r + 3 ORDER BY a.r, b.r LIMIT 20")
def keyword_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return sections.keyword_pairs(words)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'A > B/' || o_orderstatus ELSE 'A/' || o_orderpriority END AS path, CASE WHEN o_orderkey % 3 <> 0 THEN 'ottawa' END AS city FROM orders")
def paths_and_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation paths cut at the separator that is there, and keys of cities."""
    k = F.col("o_orderkey")
    path = F.when(k % 2 == 0, F.concat(F.lit(" A > B >> "), "o_orderstatus", F.lit(" >> "))).otherwise(F.concat(F.lit("A >"), "o_orderpriority"))
    city = cleaning.city_key(F.when(k % 3 == 0, "  ").otherwise(" OTTawa "))
    return table(spark, sf_dir, "orders").select("o_orderkey", _list(cleaning.path_parts(path)).alias("path"), city.alias("city"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN ' - home' ELSE 'Firm ' || c_custkey END AS name FROM customer")
def titles_to_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names from page titles, cut at known endings; a title that is nothing else stays."""
    from .functions import names

    k = F.col("c_custkey")
    firm = F.concat(F.lit("Firm "), k)
    title = F.when(k % 4 == 0, F.concat(firm, F.lit(" | HOME | more"))).when(k % 4 == 1, F.concat(firm, F.lit(" - Company Profile"))).when(k % 4 == 2, firm).otherwise(" - home")
    return table(spark, sf_dir, "customer").select("c_custkey", names.title_to_name(title).alias("name"))


@query("SELECT event_id FROM events WHERE event_id % 2 = 0 AND epoch(TIMESTAMP '2024-01-15') - floor(epoch(ts)) > 600")
def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that were downloaded and not looked at since."""
    from .sources import sinks

    runs = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("downloaded"), F.col("ts").cast("timestamp").alias("viewed_at"))
    return sinks.idle(runs, F.lit("2024-01-15").cast("timestamp")).select("event_id")


@query(V + "SELECT company_name, website, city, state, CAST(NULL AS VARCHAR) AS rationale, CAST(ord % 5 AS INTEGER) AS batch FROM v")
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an export written as CSV and read again; a column that the run does not know is null."""
    from .sources import sinks

    path = _folder(spark)
    sinks.export(X.vendors(spark, sf_dir).withColumn("batch", F.col("ord") % 5), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("company_name", "website", "city", "state", "rationale", F.col("batch").cast("int").alias("batch"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 2 = 0 THEN 'f' || c_custkey END AS phone FROM customer")
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields filled where they are empty from facts found by hand."""
    k = F.col("c_custkey")
    v = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, "kept").when(k % 3 == 1, "").alias("phone"))
    facts = v.where("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("f"), k).alias("phone"))
    return enrich.fill_if_empty(v, facts, ["phone"], "c_custkey").withColumn("phone", F.nullif("phone", F.lit("")))


@query("SELECT 'q' || p_partkey AS query, 'local' AS level, CAST(i AS INTEGER) AS position, p_brand || i AS title, 'site' || (p_partkey % 9) || '.com' AS domain FROM part, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= 1 + p_partkey % 3")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured answers of a search service, one row per result."""
    k = F.col("p_partkey")
    result = lambda i: F.struct(F.concat("p_brand", i).alias("title"), F.concat(F.lit("https://www.Site"), k % 9, F.lit(".com/"), i).alias("link"), F.lit("s").alias("snippet"))
    captured = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), k).alias("query"), F.lit("local").alias("level"), F.transform(F.sequence(F.lit(1), (1 + k % 3).cast("int")), result).alias("organic"))
    path = _folder(spark)
    captured.write.json(path)
    return feeds.search_results(spark.read.schema(captured.schema).json(path)).select("query", "level", "position", "title", "domain")


@query("SELECT 'U' || s_suppkey AS uei, s_name AS company_name, s_suppkey % 3 = 0 AS is_wosb, s_suppkey % 2 = 0 AS is_hubzone FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 4 = 1 ORDER BY s_suppkey")
def small_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of a captured certification search, by certificate and state."""
    k = F.col("s_suppkey")
    text = lambda c: F.lit(c).cast("string")
    named = lambda c: F.struct(c.alias("certification_name"))
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("U"), k).alias("uei"), text(None).alias("cage_code"), F.col("s_name").alias("businessName"), text("u").alias("url"), text("c").alias("sam_address_city"), F.when(F.col("s_nationkey") % 4 == 1, "tx").otherwise("NM").alias("sam_address_state"),
        text(None).alias("email"), text(None).alias("phone"), F.array(text("238")).alias("naics_codes"), F.when(k % 3 == 0, F.array(named(text("Women-Owned Small Business")))).alias("certifications"), F.when(k % 2 == 0, F.array(named(text("HUBZone firm")))).alias("self_certifications"),
    )
    found = feeds.small_business_companies(_json(spark, rows, "results"), certification="hubzone", state="TX", cap=1_000_000_000)
    return found.select("uei", "company_name", "is_wosb", "is_hubzone")


@query("SELECT 'R' || o_orderkey AS external_id, o_orderstatus AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'N1/N2' ELSE 'N3' END AS gsin, strftime(o_orderdate, '%Y-%m-%d') AS posted, CASE WHEN o_orderkey % 3 = 0 THEN 'http://a' ELSE '' END AS attachments FROM orders")
def open_data_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of an open-data service; fields that end in _url are attachments."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("R"), k).alias("reference_number"), F.col("o_orderstatus").alias("title_en"), F.when(k % 2 == 0, "N1, N2").otherwise("N3").alias("gsin_code"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("publication_date"),
        F.when(k % 3 == 0, "http://a").when(k % 3 == 1, "ftp://b").alias("notice_url"),
    )
    payload = _json(spark, rows, "records").select(F.struct("records").alias("result"))
    return feeds.ckan_records(payload).select("external_id", "title", _list("gsin").alias("gsin"), "posted", _list("attachments").alias("attachments"))


@query("WITH r AS (" + X.plain(X.REGISTRY) + ") SELECT vendor_key, legal_name FROM r WHERE source = 'canada_contracts' AND vendor_key IN ('s3', 's4')")
def vendor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.view(spark, sf_dir, X.REGISTRY)
    return registry.by_id(r, "s3").unionByName(registry.by_id(r, "s4").where("source = 'canada_contracts'")).select("vendor_key", "legal_name")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE '2024' END AS day FROM events")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise("2024")
    return e.select("event_id", cleaning.date_part(stamp).alias("day"))
