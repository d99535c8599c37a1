"""Seeds that keep arriving: create what is absent, batch by batch (the watching form of C15)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import ALREADY_EXISTS, COMPLETED, FINAL_PHASES, seed_if_absent

EPOCH = "epoch"


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table written by epochs; empty before the first one."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def apply_batch(
    batch: DataFrame, epoch: int, table_path: str, outcome_path: str, keys: Sequence[str], order: str
) -> None:
    """Decide one batch against the table of the epochs before it, and store the outcome.

    The batch writes folders of its own epoch, which it overwrites when it is run again.
    """
    spark = batch.sparkSession
    known = T.StructType([*batch.schema.fields, T.StructField(EPOCH, T.LongType())])
    earlier = stored(spark, table_path, known).where(F.col(EPOCH) < epoch)
    decided = seed_if_absent(batch, earlier.select(*keys), keys, order)
    place = f"{outcome_path}/{EPOCH}={epoch}"
    decided.write.mode("overwrite").parquet(place)
    added = spark.read.schema(decided.schema).parquet(place).where("added").drop("added")
    added.write.mode("overwrite").parquet(f"{table_path}/{EPOCH}={epoch}")


def _decide(keys: Sequence[str], order: str, columns: Sequence[str]):
    """What becomes of a batch's seeds of one key, given whether the key was seen. Rows are held one at a time."""

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, held = state.exists, None
        for chunk in chunks:
            final = chunk["phase"].isin(FINAL_PHASES)
            done, todo = chunk[final].assign(added=False), chunk[~final]
            if not known and len(todo):
                # The first one so far by the order is held back; all others have lost.
                both = todo if held is None else pd.concat([held, todo])
                first = int(np.argmin(both[order].to_numpy()))
                rest = np.arange(len(both)) != first
                held, todo = both[~rest], both[rest]
            lost = todo.assign(phase=ALREADY_EXISTS, added=False)
            rows = pd.concat([done, lost])
            if len(rows):
                yield rows[list(columns)]
        if held is not None:
            state.update((True,))
            yield held.assign(phase=COMPLETED, added=True)[list(columns)]

    return run


def watch_seeds(
    seeds: DataFrame,
    table_path: str,
    outcome_path: str,
    checkpoint: str,
    keys: Sequence[str],
    order: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append the absent ones of a stream of ``seeds(<keys>, <order>, phase, ...)`` to a table.

    Which keys have been seen is the stream's state, kept by key in its checkpoint, so a batch reads its own seeds
    alone, however many came before. Every seed's outcome is stored too. Batches write folders of their own epoch, which
    they overwrite when they run again, and state is taken back with them: a restart neither loses nor repeats a row. A
    NULL key is a key like any other.
    """
    fields = [*seeds.schema.fields, T.StructField("added", T.BooleanType())]
    schema = T.StructType(fields)
    run = _decide(keys, order, [f.name for f in fields])
    decided = seeds.groupBy(*keys).applyInPandasWithState(run, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def step(batch: DataFrame, epoch: int) -> None:
        place = f"{outcome_path}/{EPOCH}={epoch}"
        batch.write.mode("overwrite").parquet(place)
        added = batch.sparkSession.read.schema(schema).parquet(place).where("added").drop("added")
        added.write.mode("overwrite").parquet(f"{table_path}/{EPOCH}={epoch}")

    writer = decided.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
