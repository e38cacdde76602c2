"""Batch enrichment with a quality gate, and scorers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import given
from ..operators.enrich import split_ready
from ..session import checkpointed

Enricher = Callable[[DataFrame], DataFrame]
Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Gate:
    batch_size: int = 100
    max_batches: int = 5
    target: int = 50
    threshold: float = 40.0
    least_rate: float = 0.15
    probes: tuple[int, ...] = (150, 300)
    probe_rows: int = 20


@dataclass
class Outcome:
    enriched: list[DataFrame] = field(default_factory=list)
    scored: list[DataFrame] = field(default_factory=list)
    relevant: int = 0
    trace: list[tuple[int, int, int, int]] = field(default_factory=list)  # (start, end, ready, relevant)
    cancelled: list[str] = field(default_factory=list)  # job tags


def _batch(vendors: DataFrame, a: int, b: int, enrich: Enricher, score: Scorer, gate: Gate) -> tuple[DataFrame, DataFrame, int, int]:
    """Vendors a to b: enriched, scored, how many are ready and how many relevant. Each batch is stored before it is counted, so nothing is enriched twice."""
    enriched = checkpointed(enrich(vendors.where((F.col("place") >= a) & (F.col("place") < b))))
    ready, _ = split_ready(enriched)
    scored = checkpointed(score(ready))
    good = scored.where((F.col("capability_match_score") >= gate.threshold) & (F.coalesce("scoring_method", F.lit("")) != "rule_based")).count()
    return enriched, scored, ready.count(), good


def _gated(vendors: DataFrame, n: int, enrich: Enricher, gate: Gate, work: Callable[[int, int], tuple[DataFrame, DataFrame, int, int]]) -> Outcome:
    """The rule of the gate; work(start, end) does a batch."""
    out, at = Outcome(), 0
    for batch in range(1, gate.max_batches + 1):
        if out.relevant >= gate.target or at >= n:
            break
        end = min(at + gate.batch_size, n)
        enriched, scored, base, good = work(at, end)
        out.enriched.append(enriched)
        out.scored.append(scored)
        out.relevant += good
        out.trace.append((at, end, base, good))
        following = end
        if (good / base if base else 0.0) < gate.least_rate:
            if batch > 1:
                break
            better = None
            for p in (p for p in gate.probes if p < n):
                tried = checkpointed(enrich(vendors.where((F.col("place") >= p) & (F.col("place") < min(p + gate.probe_rows, n)))))
                rows = tried.count()
                if rows and tried.where(given(F.col("website_content"))).count() / rows > gate.least_rate:
                    better = p
                    break
            if better is None:
                break
            following = max(at + gate.batch_size, better)
        at = following
    return out


def run_gated(vendors: DataFrame, enrich: Enricher, score: Scorer, gate: Gate = Gate()) -> Outcome:  # noqa: B008
    """Batches of vendors (with `place` from 0) until enough are relevant, a batch gives too few, or batches run out.
    If the first batch is poor, a few vendors further down are tried, and the run may go on from there."""
    return _gated(vendors, vendors.count(), enrich, gate, lambda a, b: _batch(vendors, a, b, enrich, score, gate))


def run_gated_ahead(vendors: DataFrame, enrich: Enricher, score: Scorer, gate: Gate = Gate(), in_flight: int = 2) -> Outcome:  # noqa: B008
    """run_gated() with `in_flight` batches under way at once: while a batch is waited for, those that follow if it passes have begun. Batches are judged in
    their order, whichever ends first, so the outcome is run_gated()'s; batches that turn out not to be needed are cancelled by their job tag (named in
    `cancelled`)."""
    context = vendors.sparkSession.sparkContext
    n, run = vendors.count(), uuid.uuid4().hex
    going: dict[tuple[int, int], Future] = {}
    tag = lambda part: f"gate-{run}-{part[0]}"

    def one(part: tuple[int, int]) -> tuple[DataFrame, DataFrame, int, int]:
        context.addJobTag(tag(part))
        return _batch(vendors, *part, enrich, score, gate)

    cancelled = []

    def drop(keep: tuple[int, int] | None) -> None:
        for part in [p for p in going if keep is None or p < keep]:
            future = going.pop(part)
            if not future.cancel():
                context.cancelJobsWithTag(tag(part))
            cancelled.append(tag(part))

    with ThreadPoolExecutor(in_flight) as pool:

        def work(a: int, b: int) -> tuple[DataFrame, DataFrame, int, int]:
            drop((a, b))  # batches that were passed over
            at = a
            while at < n and len(going) < in_flight:
                part = (at, min(at + gate.batch_size, n))
                if part not in going:
                    going[part] = pool.submit(inheritable_thread_target(vendors.sparkSession)(one), part)
                at = part[1]
            return going.pop((a, b)).result()

        try:
            out = _gated(vendors, n, enrich, gate, work)
        finally:
            drop(None)
    out.cancelled = cancelled
    return out


def pandas_scorer(score: Callable[[pd.DataFrame], pd.Series]) -> Scorer:
    """A scorer from a pandas function of vendor rows to scores; what is null or not finite falls back on the rules."""
    from ..operators.filtering import Tender, match_rows

    def run(vendors: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vendors.schema) + ", scorer_response string"

        def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(scorer_response=[None if pd.isna(s) else f'{{"score": {s}}}' for s in score(b)])

        return match_rows(vendors.mapInPandas(one, schema), Tender()).drop("scorer_response")

    return run
