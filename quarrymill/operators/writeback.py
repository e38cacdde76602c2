"""Industry codes from similar names, written back to the stored registry in commits that can be resumed.

The store holds `vendors` by vendor_key and `vendor_codes` by vendor_key in the same number of buckets. A range of keys is a range of buckets; each range
is one commit that adds its new codes, marks its vendors and notes the range as done, all or nothing. A run that is killed goes on after
its last commit, and ranges that are done are not worked out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import match_name
from ..session import checkpointed
from ..sources.store import Change, Store
from .registry import register_names
from .similar_names import asked_names, most_similar

SOURCE = "canada_odbus_cross_reference"
FLAGS = {"naics_enriched": "boolean", "naics_source": "string", "naics_match_count": "int"}


def prepare(vendors: DataFrame, codes: DataFrame, root: str, buckets: int = 64) -> Store:
    """A store of vendors and their codes (vendor_key, code, is_primary)."""
    store = Store(vendors.sparkSession, root)
    flagged = vendors.select("*", *[F.lit(None).cast(t).alias(c) for c, t in FLAGS.items() if c not in vendors.columns])

    def put(change: Change) -> None:
        change.put("vendors", flagged, ["vendor_key"], buckets)
        change.put("vendor_codes", codes.select("vendor_key", "code", "is_primary"), ["vendor_key"], buckets)

    store.transact(put)
    return store


def pending(store: Store, ranges: int, name: str = "naics") -> list[int]:
    """Ranges that no commit has noted as done."""
    progress = store.manifest()["meta"].get(name, {"ranges": ranges, "done": []})
    if progress["ranges"] != ranges:
        raise ValueError(f"this run was begun with {progress['ranges']} ranges")
    return [r for r in range(ranges) if r not in set(progress["done"])]


def write_back_codes(
    store: Store, registry: DataFrame, registry_codes: DataFrame, ranges: int = 8, source: str = "canada_contracts", threshold: float = 0.6, most: int = 5,
    name: str = "naics",
) -> dict[str, int]:
    """For vendors of `source` that have a city: the codes of the most similar names of the registry in their city. What this run has done."""
    out = {"ranges": 0, "vendors": 0, "codes": 0}
    left = pending(store, ranges, name)
    if left:
        register = checkpointed(register_names(registry))
    bridge = registry_codes.select(F.col("vendor_key").cast("string").alias("key"), "code")
    for part in left:

        def work(change: Change, part: int = part) -> tuple[int, int]:
            buckets = change.tables["vendors"]["buckets"]
            own = [b for b in range(buckets) if b * ranges // buckets == part]
            vendors = change.read("vendors", buckets=own).where((F.col("source") == source) & F.col("city").isNotNull()).select("vendor_key", F.col("legal_name").alias("company_name"), "city")
            named = asked_names(vendors, match_name(F.col("company_name")), F.col("city"))
            matches = checkpointed(most_similar(named, register, threshold, most))
            counts = matches.groupBy("place_key", "name").agg(F.count("*").cast("int").alias("naics_match_count"))
            codes = matches.join(bridge.join(matches.select("key").distinct(), "key", "left_semi"), "key")
            codes = codes.groupBy("place_key", "name").agg(F.collect_set("code").alias("codes"))
            # a row per name until the rows are written: vendors of one name share its codes
            by_name = checkpointed(codes.join(counts, ["place_key", "name"]).where(F.size("codes") > 0))
            marked = named.join(by_name.drop("codes"), ["place_key", "name"]).select("vendor_key", F.lit(True).alias("naics_enriched"), F.lit(SOURCE).alias("naics_source"), "naics_match_count")
            before = change.read("vendor_codes", buckets=own)
            n_before = before.count()
            found = named.join(by_name.hint("merge"), ["place_key", "name"]).select("vendor_key", "codes")
            if n_before:
                has = before.groupBy("vendor_key").agg(F.collect_set("code").alias("_has"))
                found = found.join(has, "vendor_key", "left").withColumn("codes", F.array_except("codes", F.coalesce("_has", F.array().cast("array<string>"))))
            change.extend("vendor_codes", found.select("vendor_key", F.explode("codes").alias("code"), F.lit(False).alias("is_primary")))
            change.update("vendors", marked, ["vendor_key"])
            progress = change.meta.get(name, {"ranges": ranges, "done": []})
            change.meta[name] = {"ranges": ranges, "done": sorted({*progress["done"], part})}
            flagged = change.read("vendors", buckets=own).where("naics_enriched").count()
            return flagged, change.read("vendor_codes", buckets=own).count() - n_before

        vendors, codes = store.transact(work)
        out = {"ranges": out["ranges"] + 1, "vendors": out["vendors"] + vendors, "codes": out["codes"] + codes}
    return out
