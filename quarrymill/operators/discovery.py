"""Discovery: queries, their captured results, and candidates from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import unescape
from urllib.parse import parse_qs, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import MATCH_SUFFIXES, compact, domain, given, title_to_name
from .resolve import first_by_key, search_result_key

# Terms that do not fit a kind of contract; domains and words that are no vendors'.
UNFIT = {
    "service": ["supplier", "manufacturer", "distributor", "equipment", "oem", "training", "consultant", "saas", "rental", "dealer", "wholesaler", "producer", "fabricator", "vendor"],
    "product": ["services", "contractor", "consulting", "advisory", "maintenance"],
    "consulting": ["supplier", "manufacturer", "equipment", "contractor"],
}
IGNORED = ["linkedin.com", "facebook.com", "twitter.com", "instagram.com", "youtube.com", "indeed.com", "glassdoor.com", "monster.com", "wikipedia.org", "merx.com", "buyandsell.gc.ca", "sam.gov", "amazon.com", "ebay.com", "alibaba.com", "thomasnet.com", "reddit.com", "quora.com", "pinterest.com"]
NO_VENDORS = [
    "thefirearmblog.com", "ploughshares.ca", "iq.govwin.com", "ammobin.ca", "canadianarmytoday.com", "govwin.com", "tactical-life.com", "defensenews.com", "shootingillustrated.com",
    "canadabuys.canada.ca", "supportontariomade.ca", "ammoterra.com", "canada.ca", "govconexec.com", "ruralroutes.com", "211ontario.ca", "tripadvisor.com", "archive.org", "pdfcoffee.com",
    "govinfo.gov", "webgen1files1.revize.com", "yellowpages.ca", "canpages.ca", "norwalkpatriot.squarespace.com", "travel.gc.ca", "gc.ca",
]
ARTICLES = ["blog", "news", "article", "analysis", "contract award", "tender", "bid", "report", "insight"]
COMPANIES = ["inc", "ltd", "llc", "corporation", "company", "co.", "group", "systems", "solutions", "industries", "manufacturing", "manufacturer", "consulting", "services", "agency", "enterprise"]
ARTICLE_PATHS = ["/blog", "/news", "/article", "/insight", "/stories"]


def _any(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False))


def fits_contract(term: Column, contract_type: Column) -> Column:
    low = F.lower(term)
    return ~reduce(lambda rest, kv: F.when(contract_type == kv[0], _any(low, kv[1])).otherwise(rest), UNFIT.items(), F.lit(False))


def fits_recombined(term: Column) -> Column:
    return (F.length(term) > 10) & ~_any(F.lower(term), sorted({*UNFIT["service"], *UNFIT["product"]}))


def safe_terms(terms: DataFrame, patterns: dict[str, list[str]], least: float = 0.75) -> DataFrame:
    """Terms (term, contract_type, confidence) without those that match a pattern of their contract's kind, where its kind is sure enough."""
    bad = reduce(lambda rest, kv: F.when(F.col("contract_type") == kv[0], reduce(lambda a, p: a | F.col("term").rlike("(?i)" + p), kv[1], F.lit(False))).otherwise(rest), patterns.items(), F.lit(False))
    return terms.where((F.col("confidence") < least) | ~bad)


def geo_queries(terms: DataFrame, places: list[tuple[str, str | None]], executed: DataFrame | None = None) -> DataFrame:
    """(query, level, ord): every term with every place, nearest first; a query that was run, or that an earlier level
    has, is left out. The places are a handful of literals."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(p).cast("string").alias("place")) for i, (_, p) in enumerate(places)])
    rows = terms.select("ord", "term", F.explode(levels).alias("l")).select("ord", F.col("l.level").alias("level"), F.concat_ws(" ", "term", "l.place").alias("query"))
    rows = rows.withColumn("_q", F.lower("query"))
    if executed is not None:
        rows = rows.join(executed.select(F.lower("query").alias("_q")).distinct(), "_q", "left_anti")
    first = rows.groupBy("_q").agg(F.min_by(F.struct("query", "level", "ord"), F.struct("level", "ord")).alias("f"))
    return first.select("f.query", "f.level", "f.ord")


def is_company(title: Column, snippet: Column, domain: Column, url: Column) -> Column:
    d, text = F.lower(domain), F.lower(F.concat_ws(" ", title, snippet))
    path = F.lower(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1))
    article = (_any(text, ARTICLES) | _any(path, ARTICLE_PATHS)) & ~_any(text, COMPANIES)
    return (F.coalesce(d, F.lit("")) != "") & ~d.isin(NO_VENDORS) & ~_any(d, IGNORED) & ~article & ~d.endswith(".gc.ca") & ~d.endswith(".gov")


def candidates(results: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One vendor row per domain of the results that look like companies, the first by level, query and place; domains
    that are known go."""
    rows = results.where(is_company(F.col("title"), F.col("snippet"), F.col("domain"), F.col("url")))
    if seen is not None:
        rows = rows.join(seen.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_anti")
    rows = rows.withColumn("cid", F.lit(None).cast("string")) if "cid" not in rows.columns else rows
    first = first_by_key(rows, search_result_key(F.col("cid"), F.col("domain"), F.col("title")), "level", "query", "position")
    return first.withColumn("company_name", title_to_name(F.col("title"))).withColumn("website", F.col("url")).withColumn("source", F.lit("serper_discovery"))


def place_candidates(results: DataFrame) -> DataFrame:
    """One vendor per place: by its id, else by its name."""
    key = F.coalesce(F.when(F.col("cid").isNotNull(), F.concat(F.lit("cid:"), F.col("cid"))), F.concat(F.lit("title:"), compact(F.col("title"))))
    first = first_by_key(results, key, "level", "query", "position")
    return first.withColumn("company_name", F.col("title")).withColumn("source", F.lit("serper_places"))


def query_budget(deficit: int, found: int, executed: int, reserve: float = 1.3, usual: float = 5.0) -> int:
    """How many more queries should make up for the deficit, at what the earlier ones gave."""
    return int(deficit / max(found / executed if executed else usual, 0.1) * reserve)


def discover(terms: DataFrame, places: list[tuple[str, str | None]], captured: DataFrame, target: int, synonyms: list[DataFrame] = ()) -> DataFrame:
    """Candidates from captured results: terms with places first; while the target is missed, batches of synonyms,
    then, below 80 %, pairs of words of the terms. What was found is counted between steps (a list of about `target` rows)."""
    from .sections import keyword_pairs

    asked = geo_queries(terms, places)
    found = candidates(captured.join(asked.select("query", F.col("level").alias("_l")), "query").drop("level").withColumnRenamed("_l", "level"))
    for more in synonyms:
        if found.count() >= target:
            return found.limit(target)
        asked_more = geo_queries(more, places, asked)
        found = found.unionByName(candidates(captured.join(asked_more.select("query"), "query"), found))
        asked = asked.unionByName(asked_more)
    if found.count() < 0.8 * target:
        words = terms.select(F.explode(F.split(F.lower("term"), r"\s+")).alias("word"))
        pairs = keyword_pairs(words).where(fits_recombined(F.col("term")))
        found = found.unionByName(candidates(captured.join(pairs.select(F.col("term").alias("query")), "query"), found))
    return found.orderBy("level", "query", "position").limit(target)


def number(rows: DataFrame, *order: str) -> DataFrame:
    """ord: places of a bounded list in the given order."""
    return rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("long"))


# query texts and result pages


def website_query(name: Column, city: Column, state: Column, country: Column) -> Column:
    """The name without its legal suffix, and the parts of its place that it does not hold."""
    short = F.trim(F.regexp_replace(name, MATCH_SUFFIXES, ""))
    part = lambda c: F.when(given(c) & ~F.contains(short, c), c)
    return F.concat_ws(" ", short, part(city), part(state), part(country))


def contact_query(name: Column, website: Column, city: Column, state: Column) -> Column:
    own, quoted = domain(website), lambda c: F.when(given(c), F.concat(F.lit('"'), c, F.lit('"')))
    base = F.concat(F.lit('"'), name, F.lit('"'))
    on_site = F.concat(F.lit("site:"), own, F.lit(' ("sales@" OR "contact@" OR "info@" OR "hello@" OR "inquiry@") '), base)
    anywhere = F.concat(base, F.lit(" sales@ OR contact@ OR info@ OR email contact"))
    return F.concat_ws(" ", F.when(given(own), on_site).otherwise(anywhere), quoted(city), quoted(state))


def vendor_queries(terms: list[str], keywords: list[str], sector: str, city: str | None, region: str | None, most: int = 5) -> list[str]:
    """Queries for one tender: two of its terms, then its first keyword and its sector as suppliers near the place."""
    kinds, where = "supplier manufacturer", region or "Canada"
    out = terms[:2]
    if keywords and len(out) < 3:
        out = [*out, f"{keywords[0]} {kinds} {where}"]
    if city and len(out) < 4:
        out = [*out, f"{sector} {kinds} {city} {region or ''}".strip()]
    return list(dict.fromkeys(out or [f"{sector} {kinds} {where}"]))[:most]


_BLOCK = re.compile(r'<div[^>]*\bclass="[^"]*\bresult\b[^"]*"[^>]*>', re.I)
_LINK = re.compile(r'<a\b([^>]*\bclass="[^"]*\bresult__(a|snippet)\b[^"]*"[^>]*)>(.*?)</a>', re.I | re.S)
_HREF = re.compile(r'\bhref="([^"]*)"', re.I)


def result_blocks(html: str | None, most: int = 10) -> list[tuple[int, str, str, str]]:
    """(position, url, title, snippet) of a result page; a redirect is replaced by its target."""
    text = lambda x: " ".join(unescape(re.sub(r"<[^>]*>", "", x)).split())
    out = []
    for position, block in enumerate(_BLOCK.split(html or "")[1 : most + 1], 1):
        links = {kind.lower(): (attributes, body) for attributes, kind, body in reversed(_LINK.findall(block))}
        if "a" not in links:
            continue
        href = unescape((_HREF.search(links["a"][0]) or [None, ""])[1])
        if href.startswith("//") and "uddg=" in href:
            href = parse_qs(urlparse("https:" + href).query)["uddg"][0]
        if href.startswith("http"):
            out.append((position, href, text(links["a"][1]), text(links["snippet"][1]) if "snippet" in links else ""))
    return out


def parse_result_pages(pages: DataFrame, key: str = "vendor_key") -> DataFrame:
    """Rows of search results from pages (key, html), without those of ignored domains."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, h in zip(b[key], b["html"]) for r in result_blocks(h)], columns=[key, "position", "url", "title", "snippet"])

    rows = pages.select(key, "html").mapInPandas(run, f"{key} {kind}, position int, url string, title string, snippet string")
    return rows.withColumn("domain", domain(F.col("url"))).where(~_any(F.col("domain"), IGNORED) & (F.col("domain") != ""))
