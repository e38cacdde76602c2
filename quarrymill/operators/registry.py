"""The vendor registry: search by codes, words and region, lookups and statistics."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import province_forms
from ..functions.names import match_name
from ..refdata import BUSINESS_REGISTRY, FALLBACK_KEYWORDS, GENERIC_KEYWORDS, REGISTRY_SOURCES
from . import similar_names


def is_technical(keyword: str) -> bool:
    """Calibres and measures are searched as they are."""
    return bool(re.match(r"^[.\d].*\d", keyword) or re.match(r"^\d+\.?\d*\s*(mm|cal|gauge)\b", keyword.lower()))


def expand_keywords(keywords: list[str]) -> list[str]:
    out: dict[str, None] = {}
    for k in filter(None, (k.strip() for k in keywords)):
        out |= dict.fromkeys([k] if is_technical(k) else k.split())
    return list(out)


def name_matches(name: Column, keywords: list[str]) -> Column:
    """Any keyword anywhere in the name, whatever the case; % and _ are plain characters here."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(k.lower())) for k in keywords], F.lit(False))


def hierarchical_ids(bridge: DataFrame, codes: list[str], code_col: str = "code", id_col: str = "vendor_key") -> DataFrame:
    """Ids with a code that equals one of codes or, for codes of two digits and more, shares the first two: the longer
    prefixes of a code are all within that one. The codes asked for are few; both tests are pushed down to the scan."""
    given = sorted({c.strip() for c in codes if c and c.strip()})
    heads = sorted({c[:2] for c in given if len(c) >= 2})
    test = F.col(code_col).isin(given) | (F.left(F.col(code_col), F.lit(2)).isin(heads) if heads else F.lit(False))
    return bridge.where(test).select(F.col(id_col)).distinct()


def with_code_prefix(bridge: DataFrame, prefixes: list[str], code_col: str = "code", id_col: str = "vendor_key") -> DataFrame:
    """Ids with a code that begins with one of the prefixes; the test reaches the scan."""
    test = reduce(lambda a, b: a | b, [F.col(code_col).startswith(p) for p in sorted(set(prefixes))], F.lit(False))
    return bridge.where(test).select(id_col).distinct()


def search(
    vendors: DataFrame, gsin: DataFrame | None = None, unspsc: DataFrame | None = None, gsin_codes: list[str] = (), unspsc_codes: list[str] = (),
    keywords: list[str] = (), province: str | None = None, min_value: float | None = None,
) -> DataFrame:
    """Registry vendors that meet any of codes and words, and the region and value. The three ways are united as
    ids before one semi join: an OR over subqueries would become a nested loop."""
    base = vendors.where(F.col("source").isin(REGISTRY_SOURCES))
    ways = []
    if gsin_codes and gsin is not None:
        ways.append(hierarchical_ids(gsin, list(gsin_codes)))
    if unspsc_codes and unspsc is not None:
        ways.append(hierarchical_ids(unspsc, list(unspsc_codes)))
    words = expand_keywords(list(keywords))
    if words:
        ways.append(base.where(name_matches(F.col("legal_name"), words)).select("vendor_key"))
    if ways:
        base = base.join(reduce(DataFrame.unionByName, ways).distinct(), "vendor_key", "left_semi")
    if province:
        base = base.where(F.col("state").isin(province_forms(province)))
    return base.where(F.col("total_contract_value") >= min_value) if min_value else base


def two_arms(found: DataFrame, limit: int = 50) -> DataFrame:
    """Proven vendors by contract value and count, then vendors of the business registry by name; arm and place tell
    them apart. Both arms are top-k."""
    proven = found.where("total_contract_value is not null").orderBy(F.desc("total_contract_value"), F.desc_nulls_last("contract_count"), "vendor_key").limit(int(limit * 0.7))
    others = found.where(F.col("total_contract_value").isNull() & (F.col("source") == BUSINESS_REGISTRY)).orderBy("legal_name", "vendor_key").limit(int(limit * 0.3))
    return proven.withColumn("arm", F.lit(1)).unionByName(others.withColumn("arm", F.lit(2)))


def _by_value(found: DataFrame, limit: int, arm: int) -> DataFrame:
    return found.orderBy(F.desc_nulls_last("total_contract_value"), F.desc_nulls_last("contract_count"), "vendor_key").limit(limit).withColumn("arm", F.lit(arm))


def append_new(first: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """The rows of more that are not in first, behind it, `limit` in all."""
    both = first.unionByName(more.join(first.select("vendor_key"), "vendor_key", "left_anti"))
    return both.orderBy("arm", F.desc_nulls_last("total_contract_value"), F.desc_nulls_last("contract_count"), "legal_name", "vendor_key").limit(limit)


def sector_words(keywords: list[str]) -> list[str]:
    out: dict[str, None] = {}
    for k in keywords[:5]:
        for tests, words in FALLBACK_KEYWORDS:
            if any(t in k.lower() for t in tests):
                out |= dict.fromkeys(words)
                break
    return list(out)


def generic_words(keywords: list[str], sector: str | None) -> list[str]:
    low = [k.lower() for k in keywords]
    return next((w for key, w in GENERIC_KEYWORDS.items() if key in (sector or "").lower() or any(key in k for k in low)), keywords)


def search_with_fallback(vendors: DataFrame, limit: int = 500, enough: int = 100, sector: str | None = None, **query) -> DataFrame:
    """Searches wider while fewer than `enough` are found: by words of the sector, without the region, by generic
    words. Each step counts a list of at most `limit` rows on the driver."""
    keywords, province = list(query.get("keywords") or []), query.get("province")
    found = two_arms(search(vendors, **query), limit)
    if found.count() < enough:
        words = sector_words(keywords)
        if words:
            found = append_new(found, _by_value(search(vendors, keywords=words, province=province), limit, 3), limit)
        if province and found.count() < enough:
            found = append_new(found, _by_value(search(vendors, **(query | {"province": None, "min_value": None})), limit, 4), limit)
    if keywords and found.count() < enough:
        words = generic_words(keywords, sector)
        if words != keywords:
            more = two_arms(search(vendors, **(query | {"keywords": words})), limit).withColumn("arm", F.col("arm") + 4)
            found = found.unionByName(more.join(found.select("vendor_key"), "vendor_key", "left_anti"))
    return found


def to_vendor(found: DataFrame, first_contact: DataFrame | None = None) -> DataFrame:
    """Registry rows as vendor rows: location, flags, and the first contact on file."""
    from ..functions.names import flags, given

    part = lambda c: F.when(given(F.col(c)), F.col(c))
    rows = found if first_contact is None else found.join(first_contact, "vendor_key", "left")
    contact = lambda c: F.col(c) if first_contact is not None else F.lit(None).cast("string")
    return rows.select(
        "vendor_key", F.coalesce(F.nullif("legal_name", F.lit("")), F.lit("Unknown")).alias("company_name"), "website", contact("email").alias("email"), contact("phone").alias("phone"),
        F.nullif(F.concat_ws(", ", part("city"), part("state"), part("country")), F.lit("")).alias("location"), "city", "state", "country", "source",
        F.lit(True).alias("is_past_winner"), flags(F.col("total_contract_value"), F.col("contract_count")).alias("enrichment_flags"), "business_types", "total_contract_value", "contract_count",
    )


def first_contact(contacts: DataFrame) -> DataFrame:
    """The first contact of every vendor."""
    one = contacts.groupBy("vendor_key").agg(F.min_by(F.struct("first_name", "last_name", "email", "phone"), "contact_id").alias("c"))
    return one.select("vendor_key", F.nullif(F.trim(F.concat_ws(" ", "c.first_name", "c.last_name")), F.lit("")).alias("contact_name"), "c.email", "c.phone")


def by_id(vendors: DataFrame, key: str) -> DataFrame:
    return vendors.where((F.col("vendor_key") == key) & F.col("source").isin(REGISTRY_SOURCES)).limit(1)


def statistics(vendors: DataFrame, gsin: DataFrame, unspsc: DataFrame) -> DataFrame:
    """Vendors, their codes and the sum of their contracts, in one row."""
    own = vendors.where(F.col("source").isin(REGISTRY_SOURCES))
    count = lambda bridge, name: bridge.join(own.select("vendor_key"), "vendor_key").agg(F.count("*").alias(name))
    total = own.agg(F.count("*").alias("total_vendors"), F.coalesce(F.sum("total_contract_value"), F.lit(0.0)).alias("total_contract_value"))
    return total.join(count(gsin, "total_gsin_codes")).join(count(unspsc, "total_unspsc_codes"))  # three tables of one row


def coverage(vendors: DataFrame, bridge: DataFrame) -> DataFrame:
    """How many vendors have a code, by source."""
    has = bridge.select("vendor_key").distinct().withColumn("has_code", F.lit(1))
    out = vendors.join(has, "vendor_key", "left").groupBy(F.coalesce("source", F.lit("unknown")).alias("source"))
    return out.agg(F.count("*").alias("n_vendors"), F.count("has_code").alias("n_coded"), (F.count("has_code") / F.count("*")).alias("coverage"))


def filled(vendors: DataFrame, *names: str) -> DataFrame:
    """How many rows have each of these fields."""
    return vendors.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"n_{c}") for c in names])


def cross_reference(vendors: DataFrame, registry: DataFrame, threshold: float = 0.6, most: int = 5) -> DataFrame:
    """(vendor_key, match_key, similarity, place): the registry's most similar names in the vendor's city, at most `most` per vendor."""
    return similar_names.cross_reference(vendors, register_names(registry), match_name(F.col("company_name")), F.col("city"), threshold, most)


def register_names(registry: DataFrame) -> DataFrame:
    """(place_key, name, key) of the registry, as similar names are looked for."""
    return registry.select(F.lower("city").alias("place_key"), match_name(F.col("legal_name")).alias("name"), F.col("vendor_key").cast("string").alias("key"))


def cross_referenced_codes(matches: DataFrame, bridge: DataFrame) -> DataFrame:
    """(vendor_key, naics_codes): the codes of a vendor's matches."""
    codes = matches.join(bridge.select(F.col("vendor_key").alias("match_key"), "code"), "match_key")
    return codes.groupBy("vendor_key").agg(F.array_sort(F.collect_set("code")).alias("naics_codes"))


def identifier_cascade(vendors: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity of a vendor by uei, else by cage code, else by exact name; one per vendor."""
    e = lambda name: entities.select(F.col(name).alias("_k"), F.struct("entity_id", "email", "phone").alias(f"_{name}")).where("_k is not null and _k <> ''").dropDuplicates(["_k"])
    out = vendors
    for mine, theirs in (("uei", "uei"), ("cage_code", "cage_code"), ("company_name", "legal_name")):
        out = out.join(e(theirs), F.col(mine) == F.col("_k"), "left").drop("_k")
    return out.withColumn("entity", F.coalesce("_uei", "_cage_code", "_legal_name")).drop("_uei", "_cage_code", "_legal_name")
