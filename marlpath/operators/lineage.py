"""Where iterated plans are cut, so that a round neither repeats nor carries the plans of all rounds before."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once: a checkpoint in the folder that spark.checkpoint.dir names, which outlives its executors. Without that setting it is kept by the executors, and made anew from its plan where one is lost."""
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint(eager=True)
    kept = df.persist()
    kept.count()
    return kept
