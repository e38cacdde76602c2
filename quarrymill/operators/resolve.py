"""Entity resolution: who is the same vendor, and what the one that stays looks like.

Vendors arrive in an order (`ord`). A vendor is a duplicate of the kept vendor that holds its identifier, else its
website, else its name; only kept vendors hold keys. So the relation is not transitive and depends on the order.
It is decided in rounds over the whole table, whatever the components of shared keys look like; none of them is
gathered in one task. A chain, where each vendor is linked to the one before by another key, takes as many rounds as its length has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import dedup_name, given, identifier_key, truthy, website_key
from ..session import checkpointed

SCALARS = ["website", "email", "phone", "location", "city", "state", "country", "uei", "duns", "cage_code"]


def keys(vendors: DataFrame) -> DataFrame:
    """(ord, kind, key): identifiers (0), websites (1), names (2). An empty name is a key, the others need a value."""
    c = F.col
    all_keys = F.array(
        F.struct(F.lit(0).alias("kind"), identifier_key(c("uei"), c("duns"), c("cage_code")).alias("key")),
        F.struct(F.lit(1).alias("kind"), F.nullif(website_key(c("website")), F.lit("")).alias("key")),
        F.struct(F.lit(2).alias("kind"), dedup_name(c("company_name")).alias("key")),
    )
    return vendors.select("ord", F.explode(all_keys).alias("k")).select("ord", "k.kind", "k.key").where("key is not null")


def _links(state: DataFrame) -> DataFrame:
    """(ord, before): open vendors that share keys with one earlier open vendor alone. state: (kind, key, ord, first).

    Such a vendor is first or second of each of its keys, and second behind the same one. Minima again, no order within a key."""
    second = state.where("ord <> first").groupBy("kind", "key").agg(F.min("ord").alias("second"))
    near = state.join(second, ["kind", "key"], "left")
    plain = F.bool_and((F.col("ord") == F.col("first")) | (F.col("ord") == F.col("second")))
    before = F.when(F.col("ord") != F.col("first"), F.col("first"))
    one = near.groupBy("ord").agg(plain.alias("plain"), F.min(before).alias("before"), F.max(before).alias("other"))
    return one.where("plain AND before = other").select("ord", "before")


def _contracted(links: DataFrame, kept: DataFrame) -> DataFrame:
    """(ord): vendors an even number of links behind a kept one. A vendor whose one earlier neighbour is kept is a duplicate, and kept if that is one, so
    along a chain of links they alternate; pointers double until each reaches the chain's head."""
    jump = checkpointed(links.select("ord", "before", F.lit(1).alias("odd")))
    while True:
        far = jump.select(F.col("ord").alias("before"), F.col("before").alias("_to"), F.col("odd").alias("_odd"))
        longer = jump.join(far, "before", "left")
        jump = checkpointed(longer.select("ord", F.coalesce("_to", "before").alias("before"), ((F.col("odd") + F.coalesce("_odd", F.lit(0))) % 2).alias("odd"), F.col("_to").isNotNull().alias("moved")))
        moved = not jump.where("moved").isEmpty()
        jump = jump.drop("moved")
        if not moved:
            return jump.where("odd = 0").join(kept.select(F.col("ord").alias("before")), "before", "left_semi").select("ord")


def survivors(vendors: DataFrame) -> DataFrame:
    """(ord, survivor): survivor = ord for vendors that stay.

    Rounds over all vendors that are still open: one that is the first open holder of each of its keys is kept, and every
    other one that shares a key with it is a duplicate, whichever key will name its survivor. Where that leaves most of the open ones, vendors hang in chains,
    each behind one other; these are decided in the same round by doubling pointers. When all are
    decided, a duplicate's survivor is the kept vendor before it that holds its identifier, else its website, else its name."""
    known = checkpointed(keys(vendors))
    open_keys, holders, left = known, None, None
    while True:
        # a minimum and a join, not a window: a key that very many vendors share is summed up before it is moved
        state = checkpointed(open_keys.join(open_keys.groupBy("kind", "key").agg(F.min("ord").alias("first")), ["kind", "key"]))
        kept = checkpointed(state.groupBy("ord").agg(F.bool_and(F.col("first") == F.col("ord")).alias("kept")).where("kept").select("ord"))

        def decide(kept: DataFrame, state: DataFrame = state) -> tuple[DataFrame, DataFrame]:
            new = checkpointed(state.join(kept, "ord", "left_semi").select("kind", "key", F.col("ord").alias("holder")))
            # whoever shares a key with a vendor that is kept now is decided, the kept ones themselves included
            gone = state.join(new, ["kind", "key"]).select("ord").distinct()
            return new, checkpointed(state.drop("first").join(gone, "ord", "left_anti"))

        new, rest = decide(kept)
        still = rest.count()
        if still and left is not None and 2 * still > left:
            new, rest = decide(kept.unionByName(_contracted(_links(state), kept)))
            still = rest.count()
        holders = new if holders is None else holders.unionByName(new)
        open_keys, left = rest, still
        if not still:
            break
    match = known.join(holders, ["kind", "key"]).where("holder <= ord")
    return match.groupBy("ord").agg(F.min(F.struct((F.col("holder") != F.col("ord")).alias("other"), "kind", "holder")).alias("m")).select("ord", F.col("m.holder").alias("survivor"))


def first_given(name: str) -> Column:
    """The first value, in order, that is neither null nor empty; the survivor's own comes first."""
    return F.min_by(name, F.when(given(F.col(name)), F.col("ord"))).alias(name)


def ordered_distinct(rows: DataFrame, values: Column, name: str) -> DataFrame:
    """(survivor, name): distinct values in the order of their first place. Values are made distinct before they are
    collected, so a list is as long as there are different values, however many rows a survivor has."""
    each = rows.select("survivor", "ord", F.posexplode(values).alias("i", "x"))
    first = each.groupBy("survivor", "x").agg(F.min(F.struct("ord", "i")).alias("at"))
    return first.groupBy("survivor").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(name))


def merge(vendors: DataFrame, decided: DataFrame) -> DataFrame:
    """One row per survivor: its own fields, filled where they are empty from its duplicates in order; flags and
    business types united in order; contract figures as their maximum; merged_sources the duplicates' sources."""
    rows = vendors.join(decided, "ord")
    is_own = F.col("ord") == F.col("survivor")
    own = [c for c in vendors.columns if c not in (*SCALARS, "ord", "is_past_winner", "enrichment_flags", "business_types", "total_contract_value", "contract_count")]

    def most(name: str) -> Column:  # a duplicate's zero changes nothing; the survivor's own value stays if none is better
        other = F.max(F.when(~is_own & truthy(F.col(name)), F.col(name)))
        mine = F.max(F.when(is_own, F.col(name)))
        return F.when(other.isNull(), mine).otherwise(F.greatest(F.coalesce(mine, F.lit(0)), other)).cast(vendors.schema[name].dataType).alias(name)

    out = rows.groupBy("survivor").agg(
        *[F.first(F.when(is_own, F.struct(F.col(c))), ignorenulls=True)[c].alias(c) for c in own], *[first_given(c) for c in SCALARS],
        F.bool_or(F.coalesce("is_past_winner", F.lit(False))).alias("is_past_winner"), most("total_contract_value"), most("contract_count"),
    )
    lists = [
        ordered_distinct(rows, F.col("enrichment_flags"), "enrichment_flags"), ordered_distinct(rows, F.col("business_types"), "business_types"),
        ordered_distinct(rows, F.array_compact(F.array(F.when(~is_own & given(F.col("source")), F.col("source")))), "merged_sources"),
    ]
    for one in lists:
        out = out.join(one, "survivor", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(F.col(c), none) for c in ("enrichment_flags", "business_types", "merged_sources")})
    return out.withColumnRenamed("survivor", "ord").select(*vendors.columns, "merged_sources")


def deduplicate(vendors: DataFrame, merge_duplicates: bool = True) -> DataFrame:
    decided = survivors(vendors)
    if merge_duplicates:
        return merge(vendors, decided)
    return vendors.join(decided.where("ord = survivor").select("ord"), "ord").withColumn("merged_sources", F.array().cast("array<string>"))


def first_by_key(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of every key in the given order; rows without a key stay."""
    w = Window.partitionBy("_key").orderBy(*order)
    keyed = rows.withColumn("_key", key)
    first = keyed.where("_key is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.unionByName(keyed.where("_key is null")).drop("_key")


def search_result_key(cid: Column, domain: Column, title: Column) -> Column:
    """What a search result is known by: its place id, else its domain, else its title."""
    from ..functions.names import compact

    return F.coalesce(
        F.when(given(cid), F.concat(F.lit("cid:"), cid)), F.when(given(domain), F.concat(F.lit("domain:"), F.lower(domain))), F.when(given(compact(title)), F.concat(F.lit("title:"), compact(title)))
    )
