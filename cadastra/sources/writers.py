"""Publishing: stable column order, manifests, gated replacement, editions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def row_hash(df: DataFrame, columns: Sequence[str]):
    """Hash of a row's published text."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)


def publish(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "csv") -> None:
    """Write the columns in the order readers rely on."""
    out = df.select(*columns).write.mode("overwrite")
    out.csv(path, header=True) if fmt == "csv" else out.format(fmt).save(path)


def manifest(df: DataFrame, columns: Sequence[str], config: dict, parts: Sequence[str] = ()) -> DataFrame:
    """Row count, content hash and config hash of a table, per part and whole.

    The content hash adds up row hashes, so it does not depend on row or partition order.
    """
    config_hash = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
    # The whole hash in four parts, each summed by itself: a sum of 64-bit numbers fits 38 digits.
    quarters = [F.conv(F.substring("_h", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)") for k in range(4)]
    rows = df.withColumn("_h", row_hash(df, columns))
    sums = [F.count(F.lit(1)).alias("rows"), F.concat_ws("-", *[F.sum(q).cast("string") for q in quarters]).alias("content_hash")]
    whole = rows.agg(*sums).select(F.lit("all").alias("part"), "rows", "content_hash")
    by_part = rows.groupBy(F.concat_ws("/", *parts).alias("part")).agg(*sums) if parts else whole.limit(0)
    return whole.unionByName(by_part).withColumn("config_hash", F.lit(config_hash))


def write_with_manifest(df: DataFrame, path: str, columns: Sequence[str], config: dict, parts: Sequence[str] = ()) -> DataFrame:
    """Publish a table, then a manifest computed from what was written."""
    publish(df, f"{path}/data", columns, "parquet")
    written = df.sparkSession.read.parquet(f"{path}/data")
    out = manifest(written, columns, config, parts)
    out.write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.schema(out.schema).json(f"{path}/manifest")


class Rejected(ValueError):
    """A download that must not replace the store."""


def read_store(spark, store: str) -> DataFrame:
    """The newest whole version of a stored table."""
    versions = spark.read.parquet(store)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).first()[0]).drop("version")


def replace_if_valid(df: DataFrame, staging: str, store: str, required: Sequence[str], min_rows: int, complete: bool = True, received: int | None = None) -> int:
    """Replace a stored table only with a whole download: columns present, enough rows, as many as were received.

    The rows go to staging and are checked there. A valid load is then added as a new version beside the old ones, which no
    rejected or broken load touches; readers take the newest version that was written to its end.
    """
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise Rejected(f"columns missing: {', '.join(lacking)}")
    if not complete:
        raise Rejected("the download is incomplete")
    df.write.mode("overwrite").parquet(staging)
    spark = df.sparkSession
    staged = spark.read.schema(df.schema).parquet(staging)
    rows = staged.count()
    if rows < min_rows:
        raise Rejected(f"{rows} rows, at least {min_rows} expected")
    if received is not None and rows != received:
        raise Rejected(f"{rows} rows staged of {received} received")
    try:
        version = (spark.read.parquet(store).agg(F.max("version")).first()[0] or 0) + 1
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        version = 1
    staged.write.mode("overwrite").parquet(f"{store}/version={version}")
    return rows


def held_editions(spark, path: str) -> set[tuple[str, str]]:
    """Editions already stored, read from the partition folders (a handful of names)."""
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    except Exception as error:  # the folder does not exist before the first edition
        if "PATH_NOT_FOUND" in str(error):
            return set()
        raise
    keys = rows.select(F.regexp_extract("path", "kind=([^/]+)", 1).alias("kind"), F.regexp_extract("path", "key=([^/]+)", 1).alias("key")).distinct()
    return {(r["kind"], r["key"]) for r in keys.filter(F.col("key") != "").toLocalIterator()}


def write_edition(df: DataFrame, path: str, kind: str, key: str, force: bool = False) -> bool:
    """Store an edition under its kind and key; one that is held is left alone unless forced."""
    if not force and (kind, key) in held_editions(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(f"{path}/kind={kind}/key={key}")
    return True


EDITION = "kind string, key string, section string, columns string, body string"


def write_sections(sections: Mapping[str, DataFrame], path: str, kind: str, key: str, force: bool = False) -> bool:
    """Store a whole edition, all its sections in one write; one that is held is left alone unless forced.

    Each section is a partition below its kind and key, so the write replaces the sections of this edition and no
    others, all at once or not at all. A section's rows are kept as JSON beside one row with its columns, which also
    says that an empty section was written.
    """
    spark = next(iter(sections.values())).sparkSession
    if not force and (kind, key) in held_editions(spark, path):
        return False
    parts = []
    for name, rows in sections.items():
        body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
        parts.append(rows.select(F.lit(name).alias("section"), F.lit(None).cast("string").alias("columns"), body.alias("body")))
    heads = spark.createDataFrame([(n, rows.schema.json(), None) for n, rows in sections.items()], "section string, columns string, body string")
    whole = reduce(DataFrame.unionByName, parts, heads).select(F.lit(kind).alias("kind"), F.lit(key).alias("key"), "section", "columns", "body")
    # No section is longer than a league or a list, so one task a section writes one file.
    whole.repartition("section").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "key", "section").parquet(path)
    return True


def read_section(spark, path: str, section: str, kind: str | None = None, key: str | None = None) -> DataFrame:
    """A section's rows in its own columns, with kind and key, of one edition or of all that hold it."""
    rows = spark.read.schema(EDITION).parquet(path).filter(F.col("section") == section)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if key is not None:
        rows = rows.filter(F.col("key") == key)
    columns = rows.agg(F.max("columns")).first()[0]
    if columns is None:
        raise ValueError(f"no edition holds section {section}")
    schema = StructType.fromJson(json.loads(columns))
    parsed = rows.filter(F.col("body").isNotNull()).select("kind", "key", F.from_json("body", schema).alias("_r"))
    return parsed.select("kind", "key", "_r.*")


def weekly_due(held: set[tuple[str, str]], today: str, every: int = 7) -> bool:
    """Whether a week has passed since the last weekly edition."""
    import datetime as dt

    keys = sorted(k for kind, k in held if kind == "weekly" and k < today)
    return not keys or (dt.date.fromisoformat(today) - dt.date.fromisoformat(keys[-1])).days >= every
