"""Roll-ups of feed rows per vendor, and their idempotent merge into stored tables.

Feeds arrive as columns of plain names (see sources.feeds) with `ord`, the row's place in the feed. Roll-ups are
hash aggregations with partial sums; only the first 100 history entries of a vendor are kept, by a bounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import clean, content_digest, decimal, iso_date, postal_code
from ..functions.names import given
from ..session import checkpointed

HISTORY = 100


def _first(*names: str) -> list[Column]:
    """Attributes of a vendor's first row in the feed."""
    return [F.min_by(F.col(c), F.col("ord")).alias(c) for c in names]


def _codes(name: str) -> Column:
    return F.array_sort(F.collect_set(F.when(given(F.col(name)), F.col(name)))).alias(f"{name}_codes")


def _history(rows: DataFrame, keys: list[str], entry: Column, counts: Column, name: str) -> DataFrame:
    """The first entries per key: ranked and cut before they are collected, so that a list is never longer than HISTORY."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    few = rows.where(counts).withColumn("_place", place).where(F.col("_place") <= HISTORY)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_place", entry.alias("e")))), lambda s: s["e"])
    return few.groupBy(*keys).agg(lists.alias(name))


def contract_rows(feed: DataFrame) -> DataFrame:
    """Cleaned contract rows: keys, attributes, parsed value and date. Rows without a legal name go."""
    text = ["legal_name", "standardized_name", "address", "city", "state", "employee_count_range", "gsin", "unspsc", "contact_name", "contact_email", "contact_phone", "contract_number", "description", "category"]
    out = feed.select("ord", *[clean(F.col(c)).alias(c) for c in text], postal_code(F.col("postal_code")).alias("postal_code"), decimal(F.col("value")).alias("value"), iso_date(F.col("date")).alias("date"))
    return out.where(given(F.col("legal_name"))).withColumn("external_id", F.concat_ws("_", "legal_name", F.coalesce("postal_code", F.lit("NO_POSTAL"))))


def contract_rollup(rows: DataFrame, source: str = "canada_contracts", history: bool = True) -> DataFrame:
    """One row per vendor of a feed: first attributes, codes, contract figures, and its first contracts. Without history no row is ranked, and
    vendors are partly added up before they are dealt out."""
    counted = F.col("value").isNotNull() | F.col("date").isNotNull()
    out = rows.groupBy("external_id").agg(
        *_first("legal_name", "standardized_name", "address", "city", "state", "postal_code", "employee_count_range", "contact_name", "contact_email", "contact_phone"),
        _codes("gsin"), _codes("unspsc"), F.nullif(F.sum("value").cast("double"), F.lit(0.0)).alias("total_contract_value"),
        F.nullif(F.count_if(counted), F.lit(0)).alias("contract_count"), F.min("date").alias("first_contract_date"), F.max("date").alias("last_contract_date"),
    )
    if history:
        entry = F.struct(F.col("value").cast("double").alias("value"), "date", F.col("contract_number").alias("number"), "description", "category")
        out = out.join(_history(rows, ["external_id"], entry, counted, "contract_history"), "external_id", "left")
    return out.withColumn("source", F.lit(source)).withColumn("country", F.lit("CA"))


def upsert_vendors(stored: DataFrame, delta: DataFrame, fill: tuple[str, ...] = ()) -> DataFrame:
    """stored with delta merged in by (source, external_id): figures add up, dates widen, attributes stay as first seen
    (those in `fill` are filled where empty), and history is that of the first arrival. New vendors are added."""
    s, d = stored.alias("s"), delta.alias("d")
    both = s.join(d, (F.col("s.source") == F.col("d.source")) & (F.col("s.external_id") == F.col("d.external_id")), "full_outer")
    old = F.col("s.external_id").isNotNull()

    def column(c: str) -> Column:
        a, b = F.col(f"s.{c}"), F.col(f"d.{c}")
        if c in ("total_contract_value", "contract_count"):
            return F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b)
        if c == "first_contract_date":
            return F.least(a, b)
        if c == "last_contract_date":
            return F.greatest(a, b)
        if c in fill:
            return F.coalesce(F.when(given(a), a), b)
        return F.when(old, a).otherwise(b)

    return both.select(*[column(c).alias(c) for c in stored.columns])


def award_rollup(rows: DataFrame, source: str = "canada_award_notices") -> DataFrame:
    """As contract_rollup; the value is the sum of total values or, if that is nothing, of amounts (column `amount`)."""
    out = contract_rollup(rows, source).drop("total_contract_value")
    sums = rows.groupBy("external_id").agg(F.coalesce(F.nullif(F.sum("value"), F.lit(0)), F.nullif(F.sum("amount"), F.lit(0))).cast("double").alias("total_contract_value"))
    return out.join(sums, "external_id")


def split_codes(rows: DataFrame, column: str = "gsin") -> DataFrame:
    """(external_id, code) from a field that holds a code per line."""
    return rows.select("external_id", F.explode(F.split(column, r"\r?\n")).alias("code")).select("external_id", F.trim("code").alias("code")).where("code <> ''").distinct()


def standing_offers(rows: DataFrame, source: str = "canada_sosa") -> DataFrame:
    """Agreements per vendor: first and last award, last expiry, commodities, other operating names, and the agreements."""
    out = rows.groupBy("external_id").agg(
        *_first("legal_name", "standardized_name"), F.min("award_date").alias("first_contract_date"), F.max("award_date").alias("last_contract_date"),
        F.max("expiry_date").alias("last_expiry_date"), F.array_sort(F.collect_set(F.when(given(F.col("commodity")), F.col("commodity")))).alias("commodities"),
        F.array_sort(F.collect_set(F.when(given(F.col("operating_name")) & (F.col("operating_name") != F.col("legal_name")), F.col("operating_name")))).alias("operating_names"),
        F.count("*").alias("agreement_count"),
    )
    entry = F.struct("agreement_number", "agreement_type", "award_date", "expiry_date", "commodity", "description")
    return out.join(_history(rows, ["external_id"], entry, F.lit(True), "agreements"), "external_id", "left").withColumn("is_prequalified", F.lit(True)).withColumn("source", F.lit(source))


def payment_rollup(rows: DataFrame, source: str = "canada_pspc_payments") -> DataFrame:
    """Payments per vendor: their number, the last date as it is written, and the first payments."""
    out = rows.where(given(F.col("vendor_name"))).groupBy("vendor_name").agg(F.count("*").alias("payment_count"), F.max(F.nullif("payment_date", F.lit(""))).alias("last_payment_date"))
    entry = F.struct("procurement_id", "project_number", "payment_date")
    return out.join(_history(rows, ["vendor_name"], entry, F.lit(True), "payments"), "vendor_name", "left").withColumn("source", F.lit(source))


def importer_rollup(rows: DataFrame) -> DataFrame:
    """Importers with their distinct products."""
    product = F.when(given(F.col("hs_code")), F.struct("hs_code", "hs_description"))
    return rows.where(given(F.col("name"))).groupBy("external_id").agg(*_first("name", "city", "province", "postal_code"), F.array_sort(F.collect_set(product)).alias("products"))


def new_bridge_rows(stored: DataFrame, codes: DataFrame) -> DataFrame:
    """Distinct (vendor_key, code) pairs that are not stored yet."""
    return codes.select("vendor_key", "code").distinct().join(stored.select("vendor_key", "code"), ["vendor_key", "code"], "left_anti").withColumn("is_primary", F.lit(False))


def new_contacts(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Contacts whose (vendor, address) is not stored yet; one without an address is new if its vendor brings no other."""
    own = rows.withColumn("email", F.when(given(F.col("contact_email")), F.col("contact_email")))
    first = own.groupBy("vendor_key", "email").agg(F.min_by(F.struct("contact_name", "contact_phone"), "ord").alias("c"))
    name = F.split(F.trim(F.coalesce("c.contact_name", F.lit(""))), r"\s+", 2)
    out = first.join(stored.where("email is not null").select("vendor_key", "email"), ["vendor_key", "email"], "left_anti")
    return out.select("vendor_key", F.nullif(F.get(name, F.lit(0)), F.lit("")).alias("first_name"), F.get(name, F.lit(1)).alias("last_name"), "email", F.col("c.contact_phone").alias("phone"), F.lit(False).alias("is_verified"), F.lit(60).alias("confidence_score"))


def chunks(rows: DataFrame, size: int = 10_000) -> DataFrame:
    """chunk: numbers of `size` rows each, by place in the feed."""
    return rows.withColumn("chunk", F.floor(F.col("ord") / size))


def chunk_digests(chunked: DataFrame, source: str) -> DataFrame:
    """(source, chunk, digest): a digest of a chunk's rows, whatever order they are read in. A sum of row digests
    needs no task that holds a chunk."""
    cols = [F.col(c) for c in sorted(chunked.columns) if c not in ("chunk", "ord")]
    row = F.conv(F.left(content_digest(*cols), F.lit(15)), 16, 10).cast("decimal(20,0)")
    other = F.conv(F.substring(content_digest(*cols), 16, 15), 16, 10).cast("decimal(20,0)")
    out = chunked.groupBy("chunk").agg(F.sum(row).alias("_a"), F.sum(other).alias("_b"), F.count("*").alias("_n"))
    return out.select(F.lit(source).alias("source"), "chunk", F.sha2(F.concat_ws("|", "_a", "_b", "_n"), 256).alias("digest"))


def unseen(chunked: DataFrame, ledger: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows of chunks that the ledger does not know, and the ledger's new rows. Equal chunks count once."""
    new = chunk_digests(chunked, source).groupBy("source", "digest").agg(F.min("chunk").alias("chunk"))
    # written, so that rows are digested once and a short list of chunks is known to be short before rows are dealt out to meet it
    new = checkpointed(new.join(ledger.select("source", "digest"), ["source", "digest"], "left_anti"))
    return chunked.join(new.select("chunk"), "chunk", "left_semi"), new.select("source", "digest")


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of every key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), at).alias("_r")).select(*keys, "_r.*")


def cached(entries: DataFrame, now: Column) -> DataFrame:
    """Entries of a cache that are still good, the newest of every key."""
    return latest(entries, ["source", "cache_key"], "created_at").where(F.col("expires_at") > now)


def expired(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") <= now)


def fresh_files(entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Cached files whose age does not exceed the time they live."""
    return entries.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl_seconds)


def source_histogram(vendors: DataFrame) -> DataFrame:
    return vendors.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
