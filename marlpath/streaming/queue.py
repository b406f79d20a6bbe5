"""The refresh queue's state under a stream of outcomes: every micro-batch makes a new version of the tables, and one that is run again makes the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import upsert
from .clicks import apply_stream

#: Platforms that are left alone for a while after they answered 429, and what a lost lease leaves.
RATE_LIMITED = ("shopify", "woocommerce")
LEASE_LOST = "Update lease expired or was replaced before persistence"


def transitions(state: dict[str, DataFrame], outcomes: DataFrame) -> dict[str, DataFrame]:
    """listings, attempts, cooldowns and changes after outcomes (attempt_id, id, token, kind, at, changed, http_status, error, next_update_at, platform, blocked_until).

    An outcome, kind "complete", "deactivate" or "fail", counts while its token holds the listing's lease, and a
    deactivation only of an active listing; of several with one token the first counts. All others have lost their lease:
    their attempt says so and nothing else changes. A completed listing waits to be scheduled again, a failed one for next_update_at.
    Completion ends a rate-limited platform's cool-down; a 429 prolongs it.
    """
    once = Window.partitionBy("id", "token", "fits").orderBy("at", "attempt_id")
    listings = state["listings"]
    held = listings.select("id", F.col("lease_token").alias("token"), "store_active").where("token is not null")
    fits = F.coalesce(F.col("store_active").isNotNull() & ((F.col("kind") != "deactivate") | F.col("store_active")), F.lit(False))
    seen = outcomes.join(held, ["id", "token"], "left").withColumn("fits", fits)
    seen = seen.withColumn("mine", F.col("fits") & (F.row_number().over(once) == 1)).drop("store_active", "fits")
    kept = seen.where("mine").select("id", *[F.col(c).alias(f"_{c}") for c in ("kind", "at", "error", "next_update_at")])
    joined = listings.join(kept, "id", "left")
    hit, bad, done, gone = F.col("_kind").isNotNull(), F.col("_kind") == "fail", F.col("_kind") == "complete", F.col("_kind") == "deactivate"
    after = joined.withColumns({
        "next_update_at": F.when(done, F.lit(None)).when(bad, F.col("_next_update_at")).otherwise(F.col("next_update_at")),
        "failures": F.when(bad, F.col("failures") + 1).when(hit, 0).otherwise(F.col("failures")),
        "last_error": F.when(bad, F.col("_error")).when(hit, "").otherwise(F.col("last_error")),
        "store_active": F.when(gone, False).otherwise(F.col("store_active")),
        "refreshed_at": F.when(done | gone, F.col("_at")).otherwise(F.col("refreshed_at")),
        "lease_token": F.when(hit, F.lit(None)).otherwise(F.col("lease_token")),
    }).select(*listings.columns)
    kind = F.when(~F.col("mine"), "lease_lost").when(F.col("kind") == "complete", "succeeded").when(F.col("kind") == "deactivate", "deactivated").otherwise("failed")
    ends = seen.select(
        F.col("attempt_id").alias("id"), kind.alias("status"), (F.col("mine") & F.when(F.col("kind") == "complete", F.col("changed")).otherwise(F.col("kind") == "deactivate")).alias("changed"),
        F.when(F.col("mine") & (F.col("kind") == "fail"), F.col("http_status")).alias("http_status"),
        F.when(~F.col("mine"), F.lit(LEASE_LOST)).when(F.col("kind") == "fail", F.col("error")).alias("error"), F.col("at").alias("completed_at"),
    )
    ended = ["status", "changed", "http_status", "error", "completed_at"]
    attempts = upsert(state["attempts"], ends.join(state["attempts"].select("id"), "id", "left_semi"), ["id"], ended)
    limited = seen.where(F.col("mine") & F.col("platform").isin(*RATE_LIMITED))
    blocked = (F.col("kind") == "fail") & (F.col("http_status") == 429) & F.col("blocked_until").isNotNull()
    ends_at = limited.where("kind = 'complete'").groupBy("platform").agg(F.max(F.struct("at", "attempt_id")).alias("cleared"))
    after_it = limited.where(blocked).join(ends_at, "platform", "left").where(F.col("cleared").isNull() | (F.struct("at", "attempt_id") > F.col("cleared")))
    news = after_it.groupBy("platform").agg(F.max("blocked_until").alias("_until"), F.count(F.lit(1)).alias("_n")).join(ends_at.select("platform", F.lit(True).alias("_clear")), "platform", "full_outer")
    cool = state["cooldowns"].join(news, "platform", "full_outer")
    was = lambda c: F.when(F.coalesce("_clear", F.lit(False)), None).otherwise(F.col(c))
    cooldowns = cool.where(F.col("blocked_until").isNotNull() | F.col("consecutive_429s").isNotNull() | F.col("_until").isNotNull()).select(
        "platform", F.greatest(was("blocked_until"), "_until").alias("blocked_until"), (F.coalesce(was("consecutive_429s"), F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("consecutive_429s")
    )
    changes = state["changes"].unionByName(kept.where("_kind = 'deactivate'").select("id", F.lit("store_active").alias("field_name"), F.lit("true").alias("old_value"), F.lit("false").alias("new_value")))
    return {"listings": after, "attempts": attempts, "cooldowns": cooldowns, "changes": changes}


class QueueState:
    """Versions of the queue's tables under one folder: number n is what batch n - 1 made of number n - 1, and 0 is the first."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, version: int, state: dict[str, DataFrame]) -> None:
        for name, table in state.items():
            table.write.mode("overwrite").parquet(f"{self.path}/version={version}/{name}")

    def read(self, version: int) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.path}/version={version}/{n}") for n in ("listings", "attempts", "cooldowns", "changes")}

    def step(self, outcomes: DataFrame, batch_id: int) -> None:
        """One micro-batch. It reads only the version before its own and replaces its own whole, so a batch that is run again changes nothing."""
        self.write(batch_id + 1, transitions(self.read(batch_id), outcomes))

    def run(self, outcomes: DataFrame, checkpoint: str) -> StreamingQuery:
        return apply_stream(outcomes, checkpoint, self.step)
