"""Enrichment: site texts, contacts and websites from captured tables, joined to vendors."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contacts as C
from ..functions.names import base_url, compact, domain, given
from ..functions.pages import readable, site_text
from ..functions.similarity import indel_similarity, site_score

# Social and directory sites, which are no vendor's own.
SOCIAL = [
    "facebook.com", "m.facebook.com", "instagram.com", "twitter.com", "linkedin.com", "ca.linkedin.com", "zoominfo.com", "mapquest.com", "yelp.com", "squarespace.com",
    "finance.yahoo.com", "yahoo.com", "news.yahoo.com",
]


def is_social(url: Column) -> Column:
    d = domain(url)
    return reduce(lambda a, s: a | (d == s) | d.endswith("." + s), SOCIAL, F.lit(False))


def sites(pages: DataFrame, most: int = 3000) -> DataFrame:
    """(domain, website_content) of pages (domain, tier, ord, html, status)."""
    text = pages.where("tier > 0").withColumn("text", readable(least=0)(F.col("html"))).where("text is not null or status = 403")
    # every page adds a character at least, so no more than `most` pages of a domain can matter
    place = F.row_number().over(Window.partitionBy("domain").orderBy("tier", "ord"))
    text = text.withColumn("_place", place).where(F.col("_place") <= most)
    page = F.struct(F.col("tier").cast("int").alias("tier"), F.col("ord").cast("int").alias("ord"), "text", F.coalesce("status", F.lit(200)).alias("status"))
    return text.groupBy("domain").agg(site_text(F.collect_list(page), most).alias("website_content"))


def contact_pages(pages: DataFrame) -> DataFrame:
    """(domain, contact_text): all contact pages in order; the homepage only where no contact page answered."""
    text = readable(navigation=True, mails=True)
    rows = pages.where((F.col("is_contact") | (F.col("path") == "/")) & (F.coalesce("status", F.lit(200)) == 200)).withColumn("text", text(F.col("html"))).where("text is not null")
    one = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ord", "text")))), lambda s: s["text"]), "\n")
    out = rows.groupBy("domain").agg(one(F.col("is_contact")).alias("own"), one(~F.col("is_contact")).alias("home"))
    return out.select("domain", F.coalesce(F.nullif("own", F.lit("")), F.nullif("home", F.lit(""))).alias("contact_text"))


def with_content(vendors: DataFrame, site: DataFrame) -> DataFrame:
    """Site texts by domain; vendors with content, without a site or with a social one are left as they are."""
    rows = vendors if "website_content" in vendors.columns else vendors.withColumn("website_content", F.lit(None).cast("string"))
    skip = given(F.col("website_content")) | ~given(F.col("website")) | is_social(F.col("website"))
    rows = rows.withColumn("_d", F.when(~skip, domain(base_url(F.col("website")))))
    out = rows.join(site.select(F.col("domain").alias("_d"), F.col("website_content").alias("_c")), "_d", "left")
    error = F.when(F.col("_d").isNotNull() & F.col("_c").isNull(), "no_content")
    return out.withColumn("website_content", F.coalesce("website_content", "_c")).withColumn("scrape_error", error).drop("_d", "_c")


def split_ready(vendors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vendors with content, and those that need data, with the reason."""
    has = given(F.col("website_content"))
    reason = F.when(~given(F.col("website")), "no_website").otherwise(F.coalesce("scrape_error", F.lit("no_content")))
    return vendors.where(has), vendors.where(~has).withColumn("needs_data", reason)


def contact_ladder(vendors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fills address and number from the best step that has one.

    candidates: (vendor_key, level, source, confidence, emails, phones), level 1 the site, 2 snippets kept from the search
    (these fit the vendor's domain or name, or do not count), 3 a search for it, 4 a generated address. Numbers come
    from levels 1 and 2. A site's address replaces the vendor's; later steps only fill."""
    rows = candidates.join(vendors.select("vendor_key", "website", "company_name"), "vendor_key")
    fit = F.when(F.col("level").isin(2, 3), C.vendor_emails(F.col("emails"), F.col("website"), F.col("company_name"))).otherwise(F.col("emails"))
    rows = rows.withColumn("emails", fit)
    best = lambda what, test: F.min_by(F.struct(F.get(what, F.lit(0)).alias("value"), "source", "confidence", F.col(what).alias("all"), "level"), F.when((F.size(what) > 0) & test, F.col("level")))
    found = rows.groupBy("vendor_key").agg(best("emails", F.lit(True)).alias("_e"), best("phones", F.col("level") <= 2).alias("_p"))
    out = vendors.join(found, "vendor_key", "left")

    def fill(name: str, s: str) -> list[Column]:
        use = (F.col(f"{s}.level") == 1) | (~given(F.col(name)) & F.col(f"{s}.value").isNotNull())
        return [F.when(use, F.col(f"{s}.value")).otherwise(F.col(name)).alias(name), F.when(use, F.col(f"{s}.source")).alias(f"{name}_source"), F.when(use, F.col(f"{s}.confidence")).alias(f"{name}_confidence")]

    keep = [c for c in vendors.columns if c not in ("email", "phone", "email_source", "phone_source", "email_confidence", "phone_confidence")]
    out = out.select(*keep, *fill("email", "_e"), *fill("phone", "_p"))
    return out.withColumn("contact_status", C.contact_status(F.col("email"), F.col("phone")))


def site_candidates(contact_text: DataFrame) -> DataFrame:
    """Level-1 candidates of (vendor_key, contact_text)."""
    b = contact_text.withColumn("b", C.contact_bundle(F.col("contact_text")))
    return b.select("vendor_key", F.lit(1).alias("level"), F.lit("scraped_regex").alias("source"), F.col("b.confidence").alias("confidence"), "b.emails", "b.phones")


def snippet_candidates(results: DataFrame, level: int = 2) -> DataFrame:
    """Candidates of (vendor_key, organic) search results."""
    s = results.withColumn("s", C.snippet_contacts(F.col("organic")))
    return s.select("vendor_key", F.lit(level).alias("level"), F.lit("serper_backup" if level == 2 else "serper_targeted").alias("source"), F.lit(0.7).alias("confidence"), "s.emails", "s.phones")


def generated_candidates(vendors: DataFrame, mx: DataFrame, snippets: DataFrame, prefixes: list[str], least: float = 0.6) -> DataFrame:
    """Guessed addresses of domains that take mail (unknown ones count as such), of which a captured snippet
    (email, text) holds the very address; best by confidence, then by the order of prefixes."""
    own = vendors.where(given(F.col("website"))).withColumn("_d", domain(F.col("website")))
    own = own.join(mx.select(F.col("domain").alias("_d"), "has_mx"), "_d", "left").where(F.coalesce("has_mx", F.lit(True)))
    rows = own.select("vendor_key", "company_name", "_d", F.posexplode(C.email_candidates(F.col("website"), prefixes)).alias("place", "email"))
    rows = rows.join(snippets.select(F.lower("email").alias("email"), "text"), "email")
    rows = rows.withColumn("confidence", C.generated_confidence(F.col("text"), F.col("email"), F.col("company_name"), F.col("_d"))).where(F.col("confidence") >= least)
    best = rows.groupBy("vendor_key").agg(F.min_by(F.struct("email", "confidence"), F.struct(-F.col("confidence"), "place")).alias("b"))
    return best.select("vendor_key", F.lit(4).alias("level"), F.lit("generated").alias("source"), "b.confidence", F.array("b.email").alias("emails"), F.array().cast("array<string>").alias("phones"))


def fill_if_empty(vendors: DataFrame, facts: DataFrame, names: list[str], key: str = "vendor_key") -> DataFrame:
    """Fields of facts where the vendor has none."""
    f = facts.select(key, *[F.col(n).alias(f"_{n}") for n in names])
    out = vendors.join(f, key, "left")
    fields = [F.coalesce(F.when(given(F.col(n)), F.col(n)), F.col(f"_{n}")).alias(n) if n in names else F.col(n) for n in vendors.columns]
    return out.select(*fields)


def find_websites(vendors: DataFrame, results: DataFrame, least: float = 0.5) -> DataFrame:
    """The best captured result per vendor without a website: names, and the city and state in the snippet."""
    rows = vendors.where(~given(F.col("website"))).select("vendor_key", "company_name", "city", "state").join(results, "vendor_key")
    name = compact(F.regexp_replace(F.col("company_name"), r"(?i)\b(inc|ltd|llc|corp|corporation|limited|company|co)\.?$", ""))
    score = site_score(indel_similarity(name, compact(F.col("domain"))), indel_similarity(name, compact(F.col("title"))), F.col("snippet"), F.col("city"), F.col("state"))
    rows = rows.withColumn("website_confidence", score)
    best = rows.groupBy("vendor_key").agg(F.max_by(F.struct(F.col("url").alias("_website"), "website_confidence"), F.struct("website_confidence", -F.col("position"))).alias("b"))
    out = vendors.join(best, "vendor_key", "left")
    good = F.col("b.website_confidence") >= least
    return out.withColumn("website", F.coalesce(F.when(given(F.col("website")), F.col("website")), F.when(good, F.col("b._website")))).withColumn("website_confidence", F.when(good, F.col("b.website_confidence"))).drop("b")


def pick_website(organic: Column, name: Column) -> Column:
    """The first of three results whose domain holds the name, else the first result."""
    links = F.transform(F.slice(organic, 1, 3), lambda r: r["link"])
    return F.coalesce(F.get(F.filter(links, lambda u: F.contains(compact(domain(u)), compact(name))), F.lit(0)), F.get(F.transform(organic, lambda r: r["link"]), F.lit(0)))


def with_websites_cached(vendors: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Vendors with what the cache knows, also that nothing was found; and the vendors that must be searched for."""
    from .ingest import latest

    fresh = latest(cache, ["vendor_key"], "created_at").where(F.col("expires_at") > now).select("vendor_key", F.col("website").alias("_w"), F.lit(True).alias("_known"))
    out = vendors.join(fresh, "vendor_key", "left").withColumn("website", F.coalesce(F.nullif("website", F.lit("")), "_w"))
    open_ones = out.where(F.col("_known").isNull() & F.col("website").isNull() & given(F.col("city")) & given(F.col("country"))).drop("_w", "_known")
    return out.drop("_w", "_known"), open_ones


def chain(vendors: DataFrame, providers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Providers one after the other: each maps vendors to vendors."""
    return reduce(lambda df, f: f(df), providers, vendors)


def override(rows: DataFrame, overrides: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Manual values in place of found ones, with a list of what changed."""
    o = overrides.select(key, *[F.col(n).alias(f"_{n}") for n in names])
    out = rows.join(o, key, "left")
    change = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNotNull() & ~F.col(f"_{n}").eqNullSafe(F.col(n)), F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("old"), F.col(f"_{n}").cast("string").alias("new"))) for n in names]))
    fields = [F.coalesce(f"_{n}", n).alias(n) if n in names else F.col(n) for n in rows.columns]
    return out.select(*fields, change.alias("changes"))


def from_captured(rows: DataFrame, responses: DataFrame, key: str, task: str, schema: str) -> DataFrame:
    """Answers of a model, captured as (task, key, json), parsed; a fence around the JSON is cut, what does not parse is null."""
    body = F.regexp_replace(F.trim("json"), r"(?s)^```(?:json)?\s*|\s*```$", "")
    own = responses.where(F.col("task") == task).select(key, F.from_json(body, schema).alias(task))
    return rows.join(own, key, "left")
