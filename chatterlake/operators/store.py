"""The store of results, the review queue and the outbox, as tables: filters, upserts and latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a listing may be ordered by; any other is `analyzed_at`. Fixed values.
ORDERS = ("analyzed_at", "published_at", "impact_score", "risk_score", "created_at", "updated_at", "ingested_at")
#: Fact types that people review, the confidence below which they do, and the queue's size per project. Fixed values.
REVIEWED = ("entity", "sentiment", "stance", "intent", "aspect", "issue")
CERTAIN, QUEUE = 0.65, 5000


def listed(rows: DataFrame, filters: dict[str, object], order_by: str = "analyzed_at", ascending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows that meet all given equalities, ordered, with a tie broken by id; filters of None don't count."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    key = F.col(order_by if order_by in ORDERS else "analyzed_at")
    rows = rows.orderBy(key.asc() if ascending and order_by in ORDERS else key.desc(), "id")
    return rows.limit(limit) if limit and limit > 0 else rows


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the changes' rows in place of those with equal keys, and the new ones added."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def deleted(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """rows without those that meet all given equalities; with none given, nothing is left."""
    meets = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            meets &= F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return rows.filter(~meets)


def queued(facts: DataFrame, force: bool = False) -> DataFrame:
    """Facts for review: a reviewed type and a confidence below the bar, the oldest first up to the project's cap."""
    rows = facts.filter(F.col("fact_type").isin(*REVIEWED) & (F.lit(force) | (F.col("confidence") < CERTAIN)))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "item_id"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= QUEUE).drop("_rank")


def latest(events: DataFrame, key: str = "item_id", at: str = "at") -> DataFrame:
    """The last state of each item of an append-only log of states."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(at, "status")).alias("s")).select(key, "s.*")


def status_counts(events: DataFrame) -> DataFrame:
    """pending, approved, rejected, skipped: how many items are in each state."""
    found = latest(events)
    return found.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected", "skipped")])


def relayed(outbox: DataFrame, limit: int = 50) -> DataFrame:
    """The oldest pending rows, as many as one relay sends."""
    return outbox.filter("status = 'pending'").orderBy("created_at", "id").limit(limit)
