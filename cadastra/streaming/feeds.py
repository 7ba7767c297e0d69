"""Incremental feeds on Structured Streaming: scans, registrations, presence, activity, upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, LongType, StringType, StructField, StructType

from cadastra.functions.numbers import exact, total
from cadastra.operators import identity
from cadastra.sources.readers import SCAN_SCHEMA, scan_rows


def stream_scans(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Dated scan files, each read once however often the stream runs."""
    raw = spark.readStream.schema(SCAN_SCHEMA).option("header", "true").option("maxFilesPerTrigger", files_per_trigger).csv(f"{path}/scan*")
    return scan_rows(raw.select("*", F.col("_metadata.file_path").alias("_file")), F.col("_file"))


def stream_parquet(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*", files_per_trigger: int = 100) -> DataFrame:
    """Landed day files of a register."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process what has landed and stop; the checkpoint remembers it for the next run."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def land(rows: DataFrame, path: str):
    """Land a stream in a folder, one part per micro-batch; a batch that runs again replaces its own part.

    What is derived from the folder does not depend on how the feed was split into batches.
    """
    return rows.writeStream.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("epoch")


BUCKETS = 256


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _first_of_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the least by ``order`` and then by all columns; rows without a key are all kept."""
    columns = [c for c in rows.columns if c != key]
    ranked = F.struct(*[F.col(c) for c in (*[c for c in order if c != key], *[c for c in columns if c not in order])])
    kept = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(ranked).alias("_r"))
    return kept.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns]).select(*rows.columns).unionByName(rows.filter(F.col(key).isNull()))


def stream_dedupe(rows: DataFrame, path: str, key: str = "tx_key", order: Sequence[str] = (), buckets: int = BUCKETS):
    """Registrations land as they come, in folders by the hash of their key; ``registrations`` reads one row per key.

    A batch writes its own rows, one per key, and reads nothing of what is held, however much that is. Which row of a key
    counts is settled when the store is read, by ``order``, so it depends neither on arrival nor on the split. A batch
    that runs again replaces its own part.
    """

    def on_batch(batch: DataFrame, epoch: int) -> None:
        once = _first_of_key(batch, key, order).withColumn("bucket", F.coalesce(_bucket(key, buckets), F.lit(-1)))
        once.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/log/epoch={epoch}")

    return rows.writeStream.foreachBatch(on_batch)


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Epochs that compacted bases of a store reach up to, read from their folder names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "_SUCCESS")
    try:
        names = files.load(f"{path}/base").select(F.regexp_extract("path", "upto=([0-9]+)/_SUCCESS$", 1).alias("upto"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(int(r.upto) for r in names.filter("upto <> ''").distinct().toLocalIterator())


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All rows that count towards a store: its newest base and the batches after it; and the newest epoch."""
    log = spark.read.parquet(f"{path}/log")
    newest = log.agg(F.max("epoch")).first()[0]
    bases = _bases(spark, path)
    if not bases:
        return log.drop("epoch"), newest
    base = spark.read.schema(log.drop("epoch").schema).parquet(f"{path}/base/upto={bases[-1]}")
    return base.unionByName(log.filter(F.col("epoch") > bases[-1]).drop("epoch")), max(bases[-1], newest)


def registrations(spark: SparkSession, path: str, key: str = "tx_key", order: Sequence[str] = (), keys: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per key of a store, and all rows without one. Asked for some keys, only their folders are read."""
    rows, _ = _stored(spark, path)
    if keys is not None:
        wanted = spark.createDataFrame([(k,) for k in keys], "_k string").select(_bucket("_k", buckets).alias("b")).distinct()
        rows = rows.filter(F.col("bucket").isin([r.b for r in wanted.collect()]) & F.col(key).isin(list(keys)))
    return _first_of_key(rows.drop("bucket"), key, order)


def compact(spark: SparkSession, path: str, key: str = "tx_key", order: Sequence[str] = (), buckets: int = BUCKETS) -> int:
    """Settle what has landed into a new base, one row per key; the batches before it count no more and may be removed."""
    rows, newest = _stored(spark, path)
    settled = _first_of_key(rows.drop("bucket"), key, order).withColumn("bucket", F.coalesce(_bucket(key, buckets), F.lit(-1)))
    settled.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/upto={newest}")
    return newest


def lateness(rows: DataFrame, horizon_days: int = 45) -> DataFrame:
    """Days from a registration's own date to the day it was first seen, and whether that was late."""
    lag = F.datediff("first_seen", "instance_date")
    return rows.withColumn("lag_days", lag).withColumn("late", lag > horizon_days)


def stream_lateness(rows: DataFrame, sink: Callable[[DataFrame, int], None], horizon_days: int = 45):
    """Late rows are kept and counted: each micro-batch hands its lag table to ``sink``."""

    def on_batch(batch: DataFrame, epoch: int) -> None:
        counted = lateness(batch, horizon_days).groupBy("late").agg(F.count(F.lit(1)).alias("rows"), F.sum("lag_days").alias("lag_days"))
        sink(counted, epoch)

    return rows.writeStream.foreachBatch(on_batch)


LISTING_STATE = StructType([
    StructField("scan", ArrayType(LongType())), StructField("day", ArrayType(LongType())), StructField("price", ArrayType(DoubleType())),
    StructField("off_plan", ArrayType(BooleanType())), StructField("filed", ArrayType(LongType())), StructField("revision", LongType()),
])
LISTING_OUTPUT = StructType([
    StructField("listing_id", StringType()), StructField("observed_at", DateType()), StructField("asking_price", DoubleType()),
    StructField("first_price", DoubleType()), StructField("streak", LongType()), StructField("drops", LongType()), StructField("is_drop", BooleanType()),
    StructField("revision", LongType()),
])
EPOCH = pd.Timestamp(0)


@contextmanager
def state_store(spark: SparkSession):
    """Streams started within keep their state in the store that several state variables need."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


def scan_calendar(days: DataFrame) -> DataFrame:
    """observed_at and its number among the scans ever run, from a table with a row for each of them."""
    return days.select("observed_at").distinct().select("observed_at", F.row_number().over(Window.orderBy("observed_at")).cast("long").alias("scan_no"))


class ListingTracker(StatefulProcessor):
    """Per listing its scans in order of the calendar, and what each of them means: streak, first price, cuts.

    A streak is of scans that follow one another in the calendar, whatever the days between them. A
    cut counts after ``min_streak`` scans, from ``min_pct`` on, and from ``min_amount`` on unless the listing is off-plan.
    A scan that comes late takes its place, and the rows it changes are sent again under the listing's next revision.
    Of one scan day the row filed last stands. With ``keep_days`` a listing's scans are let go so many days
    after its latest, by the event time of the feed; without, they are kept, one short row a scan day.
    """

    def __init__(self, min_streak: int = 2, min_pct: float = 0.02, min_amount: float = 25_000.0, keep_days: int | None = None):
        self.min_streak, self.min_pct, self.min_amount, self.keep_days = min_streak, min_pct, min_amount, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("listing", LISTING_STATE)

    def outcomes(self, scans: dict[int, tuple]) -> dict[int, tuple]:
        """(day, price, first price, streak, drops, is a drop) of each scan by its number."""
        out: dict[int, tuple] = {}
        first, last, before, streak, drops = None, None, None, 0, 0
        for number in sorted(scans):
            at, price, off_plan, _ = scans[number]
            together = before is not None and number == before + 1
            streak = streak if together else 0
            cut = last - price if together else 0.0
            is_drop = bool(cut > 0 and streak >= self.min_streak and cut / last >= self.min_pct and (off_plan or cut >= self.min_amount))
            first = price if first is None else first
            drops, streak, last, before = drops + int(is_drop), streak + 1, price, number
            out[number] = (at, price, first, streak, drops, is_drop)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scans, revision = {}, 0
        if self.state.exists():
            *columns, revision = self.state.get()
            scans = {number: held for number, *held in zip(*columns)}
        known = self.outcomes(scans)
        for batch in rows:
            days = (pd.to_datetime(batch["observed_at"]) - EPOCH).dt.days
            for number, *scan in zip(batch["scan_no"].tolist(), days.tolist(), batch["asking_price"].tolist(), batch["is_off_plan"].tolist(), batch["filed"].tolist()):
                if number not in scans or scan[3] > scans[number][3]:
                    scans[number] = scan
        now = self.outcomes(scans)
        changed = [n for n, row in now.items() if known.get(n) != row]
        if changed:
            revision += 1
            columns = list(zip(*[(n, *scans[n]) for n in sorted(scans)]))
            self.state.update((*[list(c) for c in columns], revision))
        if self.keep_days is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((max(at for at, *_ in scans.values()) + self.keep_days) * 86_400_000)
        out = [(key[0], (EPOCH + pd.Timedelta(days=now[n][0])).date(), *now[n][1:], revision) for n in changed]
        yield pd.DataFrame(out, columns=[f.name for f in LISTING_OUTPUT])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=[f.name for f in LISTING_OUTPUT])

    def close(self) -> None:
        pass


def stream_listing_state(rows: DataFrame, calendar: DataFrame, tracker: ListingTracker | None = None, late: str = "0 seconds") -> DataFrame:
    """Presence and cuts tracked as scans land, as revisions of rows; ``listing_state`` reads them.

    ``rows``: listing_id, observed_at, asking_price, is_off_plan, filed. ``calendar``: ``scan_calendar`` of every scan up to
    the newest in the feed, a row a scan; a scan it does not name stops the stream, as its place is unknown. Files may
    come in any order and split. Only with a tracker that lets scans
    go does the feed carry a watermark, ``late`` behind its newest day, and rows behind that are left out.
    """
    tracker = tracker or ListingTracker()
    given = rows.select("listing_id", "observed_at", "asking_price", "is_off_plan", F.col("filed").cast("long").alias("filed"))
    mode = "none" if tracker.keep_days is None else "eventTime"
    if tracker.keep_days is not None:
        given = given.withColumn("scanned", F.col("observed_at").cast("timestamp")).withWatermark("scanned", late)
    given = given.join(calendar.select("observed_at", "scan_no"), "observed_at", "left")
    unknown = F.raise_error(F.concat(F.lit("a scan that the calendar does not name: "), F.coalesce(F.col("observed_at").cast("string"), F.lit("undated"))))
    given = given.withColumn("scan_no", F.coalesce("scan_no", unknown.cast("long")))
    return given.groupBy("listing_id").transformWithStateInPandas(
        statefulProcessor=tracker, outputStructType=LISTING_OUTPUT, outputMode="Append", timeMode=mode)


def listing_state(revisions: DataFrame) -> DataFrame:
    """The latest revision of every listing's scans."""
    last = F.max_by(F.struct("asking_price", "first_price", "streak", "drops", "is_drop"), "revision").alias("_r")
    return revisions.groupBy("listing_id", "observed_at").agg(last).select("listing_id", "observed_at", "_r.*")


def stream_activity(rows: DataFrame, path: str, event_time: str, keys: list[str], length: str, slide: str | None = None):
    """Rolling counts and value: tumbling when no slide is given, else sliding windows.

    A batch adds its share of each window to the folder; ``activity`` sums the shares, late rows included.
    """

    def on_batch(batch: DataFrame, epoch: int) -> None:
        span = F.window(event_time, length, slide) if slide else F.window(event_time, length)
        shares = batch.groupBy(span.alias("span"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(exact("actual_worth")).alias("worth"))
        shares.select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), *keys, "n", "worth").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return rows.writeStream.foreachBatch(on_batch)


def activity(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The windows of an activity folder: number and value of their rows so far."""
    return landed(spark, path).groupBy("window_start", "window_end", *keys).agg(F.sum("n").alias("n"), total("worth").alias("worth"))


def withdrawals(returned: DataFrame, held: DataFrame, run_date: str) -> DataFrame:
    """Withdrawal marks from all landed rows of a day (feed_date, tx_key, day_ok), however many batches brought them."""
    marks = returned.groupBy("feed_date").agg(F.count(F.lit(1)).alias("returned_rows"), F.min(F.col("day_ok").cast("int")).alias("_ok")).withColumn("ok", F.col("_ok") == 1)
    return identity.withdrawal_marks(held, returned.select("feed_date", "tx_key"), marks, run_date)
