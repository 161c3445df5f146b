"""New S1 records as a stream against fixed targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinspan.plans.linkage import CandidateGenerator, TargetContext
from kinspan.sources.tables import normalized


def match_stream(records: DataFrame, context: TargetContext, generator: CandidateGenerator, out: str, checkpoint: str, most: int = 15) -> StreamingQuery:
    """Writes the pruned candidates of every micro-batch to ``out``/batch=N.

    A batch that is run again after a failure overwrites its own folder, so the
    output holds each batch once.
    """

    def resolve(batch: DataFrame, number: int) -> None:
        found = generator.rank_and_prune(generator.generate_with_context(normalized(batch), context), most)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(resolve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
