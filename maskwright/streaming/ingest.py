"""Records as they arrive: each micro-batch goes through the same operators as a table does, and is written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import core as K
from ..functions import policy as P
from ..operators import spans as S


def redacted(records: DataFrame, rules: list[S.Rule], policy: P.Policy = K.DEFAULT_POLICY, purpose: str = "final") -> DataFrame:
    """(record_id, rendered, error) of records (record_id, text) by rules alone."""
    found = S.rule_findings(records, rules).withColumns({"source_kind": F.lit("rule"), "confidence": F.lit(None).cast("double"), "finding_id": F.col("span_id")})
    return S.redact(records, S.resolve(found), policy, purpose)


def redact_stream(records: DataFrame, path: str, checkpoint: str, rules: list[S.Rule], policy: P.Policy = K.DEFAULT_POLICY, once: bool = False) -> StreamingQuery:
    """Writes ``redacted`` of a stream to Parquet below ``path``, a folder for each batch. A batch that runs again after a
    failure replaces its own folder, so every record is written once; record ids are unique within a batch. ``once``
    takes what is there and ends. No state is kept, so late rows need no watermark, and a record id that comes again in a
    later batch is written again."""

    def write(batch: DataFrame, n: int) -> None:
        redacted(batch.select("record_id", "text"), rules, policy).write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
