"""State machines of repositories and files as pure expressions, and keyed conditional updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPO = {("seen", "skip"): "skipped", ("seen", "promote"): "pending", ("skipped", "promote"): "pending", ("pending", "claim"): "claimed", ("claimed", "done"): "done", ("claimed", "fail"): "failed", ("claimed", "reclaim"): "pending"}
FILE = {("pending", "claim"): "in_progress", ("in_progress", "done"): "done", ("in_progress", "fail"): "failed", ("in_progress", "reclaim"): "pending", ("failed", "retry"): "pending"}


def step(status: Column, event: Column, table: dict[tuple[str, str], str]) -> Column:
    """The status after event; unchanged where the table has no such step. Any repository may go missing."""
    out = status
    for (a, e), b in table.items():
        out = F.when((status == a) & (event == e), F.lit(b)).otherwise(out)
    return F.when(event == "missing", F.lit("missing")).otherwise(out) if table is REPO else out


def stale(claimed_at: Column, now: Column, ttl: str) -> Column:
    return claimed_at < now - F.expr(f"INTERVAL {ttl}")


def reclaim(rows: DataFrame, now: Column, ttl: str, at: str = "claimed_at") -> DataFrame:
    late = (F.col("status") == "claimed") & F.coalesce(stale(F.col(at), now, ttl), F.lit(False))
    return rows.withColumns({"status": F.when(late, "pending").otherwise(F.col("status")), "claimed_by": F.when(~late, F.col("claimed_by")), at: F.when(~late, F.col(at))})


def claim_next(rows: DataFrame, worker: str, n: int = 1) -> DataFrame:
    """The n pending rows of highest rate, as claimed by worker."""
    return rows.filter("status = 'pending'").orderBy(F.col("rate").desc(), "id").limit(n).withColumn("status", F.lit("claimed")).withColumn("claimed_by", F.lit(worker))


def conditional_update(rows: DataFrame, outcome: DataFrame, columns: list[str]) -> DataFrame:
    """Apply outcome (id, claimed_by, columns) where id and claimed_by both match; the rest stays."""
    new = outcome.select(F.col("id").alias("__id"), F.col("claimed_by").alias("__by"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, (F.col("id") == F.col("__id")) & F.col("claimed_by").eqNullSafe(F.col("__by")), "left")
    out = out.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns})
    return out.drop("__id", "__by", "__hit", *[f"__{c}" for c in columns])


def cas_misses(rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """Rows of outcome whose id is no longer claimed by their worker: conditional_update passes over them."""
    held = rows.select("id", "claimed_by")
    same = (outcome["id"] == held["id"]) & outcome["claimed_by"].eqNullSafe(held["claimed_by"])
    return outcome.join(held, same, "left_anti")


def settle(rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """Mark outcomes (id, claimed_by, ok, reason, elapsed): done or failed with the reason, where the claim still holds."""
    ok = F.col("ok")
    new = outcome.select("id", "claimed_by", F.when(ok, "done").otherwise("failed").alias("status"), F.when(~ok, F.col("reason")).alias("failure_reason"), F.col("elapsed").alias("processing_time_sec"))
    return conditional_update(rows, new, ["status", "failure_reason", "processing_time_sec"])


def worker_id(host: Column, slot: Column) -> Column:
    return F.concat_ws("-", host, slot.cast("string"))


def scratch_path(root: str, repo: Column, worker: Column) -> Column:
    """A folder of its own for each repository and worker."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), F.concat_ws("-", worker, repo.cast("string")))


def last_before(rows: DataFrame, key: str, value: str, at: str, cutoff: Column) -> DataFrame:
    """(key, value) of the latest row of each key before cutoff, ties to the larger value; keys without one are left out."""
    return rows.filter(F.col(at) < cutoff).groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias(value))


def backfill(rows: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fill columns that are null; what is there stays, so a second run changes nothing."""
    new = fresh.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, F.col(key) == F.col("__k"), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")))
    return out.drop("__k", *[f"__{c}" for c in columns])


def seed(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """Ledger plus a pending row for each id that it lacks."""
    new = ids.select("file_id").distinct().join(ledger, "file_id", "left_anti").withColumn("status", F.lit("pending"))
    return ledger.unionByName(new, allowMissingColumns=True)
