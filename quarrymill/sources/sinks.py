"""Writers: exports, run tables, stored rows, the job registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Change, Store

EXPORT = [
    "company_name", "website", "email", "phone", "location", "city", "state", "country", "industry", "source", "is_past_winner", "capability_match_score", "rationale", "match_status", "match_reason", "batch",
]


def export_columns(matches: DataFrame) -> DataFrame:
    """The columns of an export, in order; what a run does not know is null."""
    return matches.select(*[F.col(c) if c in matches.columns else F.lit(None).cast("string").alias(c) for c in EXPORT])


def export(matches: DataFrame, path: str, kind: str = "csv") -> None:
    """csv, json or parquet. An empty CSV still has its header."""
    rows = export_columns(matches)
    if kind == "csv":
        rows = rows.coalesce(1) if rows.isEmpty() else rows
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind in ("json", "parquet"):
        getattr(rows.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"no writer for {kind}")


def flat(matches: DataFrame) -> DataFrame:
    """Nested columns as JSON strings, for readers that know no lists."""
    nested = lambda f: f.dataType.typeName() in ("array", "map", "struct")
    return matches.select(*[F.to_json(F.col(f.name)).alias(f.name) if nested(f) else F.col(f.name) for f in matches.schema])


def nested(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The inverse of flat() for the columns of schema."""
    return rows.select(*[F.from_json(c, schema[c]).alias(c) if c in schema else F.col(c) for c in rows.columns])


def write_run(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], root: str, buckets: int = 16) -> int:
    """The tables of a run (name: rows and their key column) in the store at root, all at one version; which version."""

    def put(change: Change) -> None:
        for name, (df, key) in tables.items():
            change.put(name, df, [key], buckets)

    store = Store(spark, root)
    store.transact(put)
    return store.version()


def update_row(spark: SparkSession, root: str, name: str, key: object, values: dict[str, object]) -> None:
    """Sets columns of the row with this key. One bucket of the table is read and written; readers see the row before or after."""

    def update(change: Change) -> None:
        table = change.tables[name]
        types = {f["name"]: f for f in table["schema"]["fields"]}
        row = {table["keys"][0]: key, **values}
        schema = StructType.fromJson({"type": "struct", "fields": [types[c] | {"nullable": True} for c in row]})
        change.update(name, spark.createDataFrame([tuple(row.values())], schema), table["keys"])

    Store(spark, root).transact(update)


def copy_table(spark: SparkSession, read: dict[str, str], write: dict[str, str]) -> tuple[int, int]:
    """Copies a table between databases by JDBC options; rows read and rows there afterwards."""
    df = spark.read.format("jdbc").options(**read).load()
    df.write.format("jdbc").options(**write).mode("append").option("batchsize", 1000).save()
    return df.count(), spark.read.format("jdbc").options(**write).load().count()


def candidate_key(*cols: Column) -> Column:
    """The key under which a run's candidates are stored."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


# job registry: an append-only table of (run_id, status, started_at, updated_at), the newest row of a run counts


def register_job(spark: SparkSession, path: str, run_id: str, status: str, started_at: str, updated_at: str) -> None:
    row = spark.createDataFrame([(run_id, status, started_at, updated_at)], "run_id string, status string, started_at string, updated_at string")
    row.write.mode("append").parquet(path)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.ingest import latest

    return latest(spark.read.parquet(path), ["run_id"], "updated_at").where("status <> 'removed'")


def pick_job(jobs: DataFrame, *keys: str) -> DataFrame:
    """The job to show, per key: a running one before a completed before a failed one, the newest of these."""
    rank = F.when(F.col("status") == "running", 0).when(F.col("status") == "completed", 1).when(F.col("status") == "failed", 2).otherwise(3)
    best = F.min_by(F.struct(*[c for c in jobs.columns if c not in keys]), F.struct(rank.alias("r"), (-F.unix_micros(F.col("started_at").cast("timestamp"))).alias("s")))
    return jobs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def idle(runs: DataFrame, now: Column, seconds: int = 600) -> DataFrame:
    """Runs that were downloaded and not looked at for some time."""
    return runs.where(F.col("downloaded") & (F.unix_timestamp(now) - F.unix_timestamp("viewed_at") > seconds))
