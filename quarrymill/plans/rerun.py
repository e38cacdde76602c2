"""A run that can be taken up again with other values of its tender, working on what these move.

The store holds two tables by `ord`. `judged` has every vendor that is left after duplicates, which no value of the tender changes, with what filter and
ranking say of it; `matches` has the scores of the vendors that were candidates once, with the values of the tender that they were scored
for. A re-run reads the columns that rules look at, writes the rows whose judgement differs, takes the candidates from the narrow table
and scores those that have no score for these values yet. Judgements, scores and the tender change in one commit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import filtering, resolve
from ..operators.filtering import FilterConfig, Tender
from ..session import checkpointed
from ..sources.store import Change, Store, replace_rows

JUDGEMENT = ["geo_score", "geo_tier", "stays", "exclusion_reason", "preliminary_score"]
#: Columns of a vendor that the rules of filter and ranking read.
RULE_INPUTS = ["state", "business_types", "total_contract_value", "is_past_winner", "enrichment_flags", "source"]
Scorer = Callable[[DataFrame, Tender], DataFrame]


def _judge(rows: DataFrame, tender: Tender, config: FilterConfig, expansion: bool) -> DataFrame:
    """rows with JUDGEMENT; `stays` is what the geographic filter lets through."""
    if not config.geographic or not config.local_first or not tender.state:
        placed = rows.withColumn("geo_score", F.lit(0.0)).withColumn("geo_tier", F.lit(None).cast("string")).withColumn("stays", F.lit(True))
    else:
        placed = filtering.with_geo(rows, tender)
        placed = placed.withColumn("stays", F.lit(True) if config.sort_by_distance or expansion else F.col("geo_tier") != "national")
    reasoned = filtering.with_reason(placed, tender, config) if config.eligibility else placed.withColumn("exclusion_reason", F.lit(None).cast("string"))
    return filtering.with_preliminary(reasoned, tender)


def _scored_for(tender: Tender) -> str:
    """The values of a tender that scores and rationales depend on."""
    return repr((tender.naics, tender.project_type))


def _candidates(change: Change, config: FilterConfig) -> DataFrame:
    narrow = change.read("judged").where("stays AND exclusion_reason IS NULL").select("ord", "company_name", "preliminary_score", "geo_score", "geo_tier")
    return filtering.ranked(narrow, config.max_candidates)


def _score_missing(change: Change, tender: Tender, config: FilterConfig, score: Scorer) -> int:
    """Scores the candidates without a score for this tender; how many."""
    own = _candidates(change, config).select("ord")
    if "matches" in change.tables:
        own = own.join(change.read("matches").where(F.col("scored_for") == _scored_for(tender)).select("ord"), "ord", "left_anti")
    rows = change.read("judged").join(checkpointed(own), "ord").drop(*JUDGEMENT)
    done = checkpointed(score(rows, tender).withColumn("scored_for", F.lit(_scored_for(tender))))
    change.upsert("matches", done, ["ord"], replace_rows(["ord"]), change.tables["judged"]["buckets"])
    return done.count()


def rule_scores(vendors: DataFrame, tender: Tender) -> DataFrame:
    return filtering.match_rows(vendors, tender).select("ord", "capability_match_score", "scoring_method", "rationale", "match_status", "match_reason")


def first_run(store: Store, vendors: DataFrame, tender: Tender, config: FilterConfig = FilterConfig(), score: Scorer = rule_scores, buckets: int = 16) -> dict[str, int]:  # noqa: B008
    """A run from the start. How many vendors were judged and scored."""
    unique = checkpointed(resolve.deduplicate(vendors) if config.duplicates else vendors)
    n = unique.count()

    def work(change: Change) -> dict[str, int]:
        change.tables = {k: v for k, v in change.tables.items() if k not in ("judged", "matches")}
        change.put("judged", _judge(unique, tender, config, n < config.expansion_threshold), ["ord"], buckets)
        change.meta["run"] = {"tender": asdict(tender), "vendors": n}
        return {"judged": n, "scored": _score_missing(change, tender, config, score), "vendors": n}

    return store.transact(work)


def rerun(store: Store, overrides: dict[str, object], config: FilterConfig = FilterConfig(), score: Scorer = rule_scores) -> dict[str, int]:  # noqa: B008
    """The run with some values of its tender replaced. How many vendors were judged anew and scored anew, of how many."""

    def work(change: Change) -> dict[str, int]:
        run = change.meta["run"]
        before = Tender(**(run["tender"] | {"naics": tuple(run["tender"]["naics"])}))
        tender = Tender(**(asdict(before) | overrides))
        if tender == before:
            return {"judged": 0, "scored": 0, "vendors": run["vendors"]}
        old = F.struct(*[F.col(c) for c in JUDGEMENT])
        narrow = change.read("judged").select("ord", *RULE_INPUTS, old.alias("_old"))
        new = _judge(narrow, tender, config, run["vendors"] < config.expansion_threshold)
        moved = checkpointed(new.where(~F.struct(*[F.col(c) for c in JUDGEMENT]).eqNullSafe(F.col("_old"))).select("ord", *JUDGEMENT))
        change.update("judged", moved, ["ord"])
        change.meta["run"] = run | {"tender": asdict(tender)}
        return {"judged": moved.count(), "scored": _score_missing(change, tender, config, score), "vendors": run["vendors"]}

    return store.transact(work)


def shortlist(store: Store, config: FilterConfig = FilterConfig()) -> DataFrame:  # noqa: B008
    """The candidates of the stored run with their scores, and their place in the ranking."""
    change = store.begin()
    total = (F.col("preliminary_score") + F.coalesce("geo_score", F.lit(0.0))).alias("total")
    top = _candidates(change, config).select("ord", "company_name", "geo_tier", total)
    order = [F.desc("total"), F.desc("company_name"), geo.tier_rank(F.col("geo_tier")), F.col("ord")]
    return filtering.batches(top.join(change.read("matches").drop("scored_for"), "ord"), order, 1).withColumnRenamed("batch", "place")
