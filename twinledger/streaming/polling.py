"""Incremental reconciliation of file drops, and exactly-once windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from twinledger.functions.ids import parse_id_spec
from twinledger.model import STATUS_NO_DATA, STATUS_SUCCESS, CompareScope, SideConfig
from twinledger.operators.compare import KEY, diff_summary, missing_on_both_sides, presence
from twinledger.operators.records import extract_data
from twinledger.plans.reconcile import reconcile_ruleset

# Payloads wait as text; the default formats would cut times to milliseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def drop_stream(
    spark: SparkSession, path: str, file_format: str, schema: T.StructType | str,
    archive: str | None = None, **options,
) -> DataFrame:
    """New files of a folder, newest first; consumed ones move to ``archive``."""
    reader = spark.readStream.format(file_format).schema(schema).option("latestFirst", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path).select(
        "*", F.struct(
            F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_name").alias("name")
        ).alias("_file"),
    )


def _side_rows(stream: DataFrame, side: SideConfig, kind: str, number: int) -> tuple[DataFrame, T.DataType]:
    """Tagged ``(side, compare_id, payload, file)`` rows of one side, and what the payload is."""
    spec = parse_id_spec(side.id_expression, kind, side.id_normalizer)
    rows = extract_data(stream, spec, side.label, keep=("_file",))
    tagged = rows.select(
        F.lit(number).alias("side"), KEY, F.to_json("data", TIMES).alias("payload"), F.col("_file").alias("file")
    )
    return tagged, rows.schema["data"].dataType


def _newest_only(batch: DataFrame) -> DataFrame:
    """Rows of the newest file of each side: two keys, so a two-row broadcast."""
    newest = batch.groupBy("side").agg(F.max("file").alias("_newest"))
    return batch.join(F.broadcast(newest), "side").filter(F.col("file").eqNullSafe(F.col("_newest"))).drop("_newest")


def _pending(batch: DataFrame, batch_id: int, out: str) -> DataFrame:
    """The batch with what earlier polls left waiting for the other side."""
    spark = batch.sparkSession
    if batch_id == 0:
        return batch
    return batch.unionByName(spark.read.schema(batch.schema).parquet(f"{out}/pending/batch_id={batch_id - 1}"))


def reconcile_batch(
    batch: DataFrame, batch_id: int, out: str, label1: str, label2: str, latest_only: bool = False,
    scope: CompareScope | None = None, payloads: tuple[T.DataType, T.DataType] | None = None,
) -> None:
    """Compare the two sides of one micro-batch and write it under its batch id.

    With a ``scope`` its whole rule set is run, on the parsed ``payloads``, and
    rows have the thirteen-column layout.

    A side that comes alone is not lost: its rows wait in ``pending`` until
    the other one arrives, and are compared then.  All targets are named by
    the batch and overwritten, so a replay after a failure reads the pending
    rows of the batch before and writes the same result again.
    """
    rows = _pending(batch, batch_id, out)
    cached = (_newest_only(rows) if latest_only else rows).persist()
    ids = None
    try:
        sides = []
        for number in (1, 2):
            own = cached.filter(F.col("side") == number)
            sides.append(own.select(KEY, F.struct(F.col("payload")).alias("data")))
        ids = presence(sides[0].select(KEY), sides[1].select(KEY)).persist()
        found = cached.agg(
            F.count_if(F.col("side") == 1).alias("file1_count"), F.count_if(F.col("side") == 2).alias("file2_count")
        ).first()
        has_data = found["file1_count"] > 0 and found["file2_count"] > 0
        if has_data:
            if scope is not None:
                full = [own.select(KEY, F.from_json("data.payload", kind, TIMES).alias("data")) for own, kind in zip(sides, payloads)]
                diffs = reconcile_ruleset(full[0], full[1], scope, count=False).diffs
            else:
                diffs = missing_on_both_sides(sides[0], sides[1], ids, label1, label2).withColumn(
                    "data", F.get_json_object("data", "$.payload")
                )
            diffs.write.mode("overwrite").json(f"{out}/differences/batch_id={batch_id}")
        waiting = cached.filter(F.lit(not has_data))
        waiting.write.mode("overwrite").parquet(f"{out}/pending/batch_id={batch_id}")
        row = diff_summary(ids).select(
            F.lit(STATUS_SUCCESS if has_data else STATUS_NO_DATA).alias("statusEnumId"),
            F.lit(found["file1_count"]).cast("bigint").alias("file1_count"),
            F.lit(found["file2_count"]).cast("bigint").alias("file2_count"),
            *[F.when(F.lit(has_data), F.col(c)).otherwise(0).cast("bigint").alias(c)
              for c in ("only_in_file1", "only_in_file2", "matched")],
        )
        row.coalesce(1).write.mode("overwrite").json(f"{out}/runs/batch_id={batch_id}")
    finally:
        cached.unpersist()
        if ids is not None:
            ids.unpersist()


def stream_poll_reconcile(
    stream1: DataFrame, stream2: DataFrame, side1: SideConfig, side2: SideConfig, out: str,
    checkpoint: str, kind1: str = "JSON", kind2: str = "JSON", latest_only: bool = False,
    interval: str | None = None, scope: CompareScope | None = None,
) -> StreamingQuery:
    """Reconcile whatever both folders received since the last poll, by the rule set of ``scope`` if one is given.

    Without ``interval`` everything available is taken once; with it the
    folders are polled.  A poll without files on a side records no data and
    keeps the other side's rows for the next one.
    """
    label1, label2 = side1.label or "File 1", side2.label or "File 2"
    (rows1, payload1), (rows2, payload2) = _side_rows(stream1, side1, kind1, 1), _side_rows(stream2, side2, kind2, 2)
    both = rows1.unionByName(rows2)

    def run(batch: DataFrame, batch_id: int) -> None:
        reconcile_batch(batch, batch_id, out, label1, label2, latest_only, scope, (payload1, payload2))

    writer = both.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


WINDOW_KEYS = ["automationId", "scheduledDate", "childWindowStart", "childWindowEnd"]


def stream_idempotent_windows(
    stream: DataFrame, accepted: str, checkpoint: str, keys: list[str] | None = None, interval: str | None = None
) -> StreamingQuery:
    """Write each automation window to the ``accepted`` table once, however often and late it is submitted.

    The table itself is the memory: a batch adds the windows that no other
    batch has added, so nothing is dropped for being late or let in again.
    A replayed batch overwrites its own rows.
    """
    keys = keys or WINDOW_KEYS
    spark, schema = stream.sparkSession, stream.schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{accepted}/batch_id=-1")

    def run(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(accepted)
        earlier = known.filter(F.col("batch_id") != batch_id).select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        new = batch.dropDuplicates(keys).join(earlier, same, "left_anti")
        new.write.mode("overwrite").parquet(f"{accepted}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()
