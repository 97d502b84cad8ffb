"""A content-addressed result cache as a Parquet table: keys, lookups, appends, expiry and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_pages, normalise_question
from ..settings import Settings
from ..staging import stage

SCHEMA_VERSION = 2
KEY_FORMAT = "^[0-9a-f]{64}$"


def cache_key(settings: Settings, *, sha256: Column, mode: Column, profile: Column, detail: Column, pages: Column, question: Column, processor: Column, processor_version: Column, extension: Column, prompt_version: str = "2", ocr_version: str = "") -> Column:
    """Hash of all that shapes a result. Path, output budget and API key are not part of it."""
    fields = {
        "schema": F.lit(str(SCHEMA_VERSION)), "sha256": sha256, "mode": mode, "vision_profile": profile, "detail": detail, "pages": normalise_pages(pages),
        "question": F.sha2(normalise_question(question), 256), "processor": processor, "processor_version": processor_version, "extension": extension,
        "prompt_version": F.lit(prompt_version), "ocr_version": F.lit(ocr_version), "vision_base_url": F.lit(settings.base_url),
    }
    for name in ("max_pages", "ocr_backend", "ocr_languages", "send_ocr_to_cloud", "vision_provider", "model", "vision_route", "vision_max_output_tokens", "allow_cloud_vision", "auto_image_strategy", "pdf_min_chars_per_page", "pdf_render_dpi", "vision_max_dimension", "vision_max_image_bytes", "vision_image_format", "max_image_pixels"):
        fields[name] = F.lit(str(getattr(settings, name)))
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(k + "="), F.coalesce(fields[k], F.lit(""))) for k in sorted(fields)]), 256)


def _age(now: Column) -> Column:
    """Seconds from ``stored_at`` to ``now``, each rounded to a whole second first (halves to even), as ``epoch(...)::BIGINT`` does in SQL."""
    whole = lambda at: F.rint(F.unix_micros(at.cast("timestamp")) / 1e6).cast("long")
    return whole(now) - whole(F.col("stored_at"))


def lookup(requests: DataFrame, entries: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """Adds ``payload``, ``stored_at`` and ``cache_status`` (hit, expired or miss). The latest writer of a key counts.

    ``now`` is given, never read from the clock, so that results can be compared.
    ``entries`` is reduced to one row for each key before the join; hot keys of
    ``requests`` are split by adaptive execution.
    """
    latest = entries.where(F.col("schema_version") == SCHEMA_VERSION).groupBy("cache_key").agg(F.max("stored_at").alias("stored_at"), F.max_by("payload", "stored_at").alias("payload"))
    fresh = F.lit(True) if ttl_days <= 0 else _age(now) <= ttl_days * 86400
    joined = requests.join(latest, "cache_key", "left")
    status = F.when(F.col("stored_at").isNull(), "miss").when(fresh, "hit").otherwise("expired")
    return joined.withColumn("cache_status", status).withColumn("payload", F.when(F.col("cache_status") == "hit", F.col("payload")))


def put(results: DataFrame, path: str) -> None:
    """Append entries; Spark's commit makes a batch visible at once or not at all."""
    results.where(F.col("cache_key").rlike(KEY_FORMAT)).select("cache_key", "schema_version", "stored_at", "last_access", "size_bytes", "payload").write.mode("append").parquet(path)


def _before(entries: DataFrame, size: str, order: list[str], slots: int) -> DataFrame:
    """Adds ``__before`` and ``__total``: sizes of all entries that come earlier, and of all.

    A window over everything would be one task. Entries are cut into ranges of
    the whole order, so that entries of one time are spread too, and written; a
    range sums its own, and the ranges before it are a running sum over one row
    for each range.
    """
    ranged = stage(entries.repartitionByRange(slots, *order).withColumn("__slot", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__slot").agg(F.sum(size).alias("__sum"))
    running = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("__slot", F.coalesce(F.sum("__sum").over(running), F.lit(0)).alias("__start"), F.sum("__sum").over(Window.partitionBy()).alias("__total"))
    own = Window.partitionBy("__slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("__own", F.coalesce(F.sum(size).over(own), F.lit(0))).join(starts, "__slot").withColumn("__before", F.col("__start") + F.col("__own"))


def evict(entries: DataFrame, budget: int, *, size: str = "size_bytes", order: tuple[str, ...] = ("last_access", "size_bytes", "cache_key"), slots: int = 256) -> DataFrame:
    """Adds ``evicted``: the longest untouched go first, until what is left fits the budget."""
    summed = _before(entries, size, list(order), slots)
    return summed.withColumn("evicted", F.col("__total") - F.col("__before") > budget).drop("__slot", "__own", "__start", "__total", "__before")


def cleanup(entries: DataFrame, now: Column, ttl_days: int, budget: int, **options) -> DataFrame:
    """One row: expired, evicted, kept and kept_bytes."""
    old = (_age(now) > ttl_days * 86400) if ttl_days > 0 else F.lit(False)
    marked = evict(entries.where(~old), budget, **options).withColumn("expired", F.lit(False))
    gone = entries.where(old).withColumns({"evicted": F.lit(False), "expired": F.lit(True)})
    stays = ~F.col("evicted") & ~F.col("expired")
    size = F.col(options.get("size", "size_bytes"))
    return marked.unionByName(gone).agg(F.count_if("expired").alias("expired"), F.count_if("evicted").alias("evicted"), F.count_if(stays).alias("kept"), F.coalesce(F.sum(F.when(stays, size)), F.lit(0)).alias("kept_bytes"))


def touch(keys: DataFrame, now: Column, path: str) -> None:
    """Note that the entries of ``keys`` were used. Notes are appended beside the table and taken in by ``upkeep``."""
    keys.select("cache_key").distinct().withColumn("last_access", now).write.mode("append").parquet(path + ".used")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The latest entry of each key, with the time at which it was last used."""
    table = spark.read.parquet(path)
    latest = table.groupBy("cache_key").agg(F.max_by(F.struct(*[c for c in table.columns if c != "cache_key"]), "stored_at").alias("e")).select("cache_key", "e.*")
    if not _exists(spark, path + ".used"):
        return latest
    used = spark.read.schema("cache_key string, last_access timestamp").parquet(path + ".used").groupBy("cache_key").agg(F.max("last_access").alias("__used"))
    return latest.join(used, "cache_key", "left").withColumn("last_access", F.greatest("last_access", "__used")).drop("__used")


def upkeep(spark: SparkSession, path: str, now: Column, ttl_days: int, budget: int) -> DataFrame:
    """Rewrite the table without what has expired or must go, and say how much that was (as ``cleanup`` does)."""
    held = stage(entries(spark, path), "entries")
    fresh = held.where(_age(now) <= ttl_days * 86400) if ttl_days > 0 else held
    marked = stage(evict(fresh, budget), "marked")
    kept = marked.where(~F.col("evicted"))
    kept.drop("evicted").write.mode("overwrite").parquet(path + ".next")
    _swap(spark, path)
    _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path + ".used"), True)
    gone = held.count() - marked.count()
    return marked.agg(F.lit(gone).cast("long").alias("expired"), F.count_if("evicted").alias("evicted"), F.count_if(~F.col("evicted")).alias("kept"), F.coalesce(F.sum(F.when(~F.col("evicted"), F.col("size_bytes"))), F.lit(0)).alias("kept_bytes"))


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def _swap(spark: SparkSession, path: str) -> None:
    """Put ``path``.next in the place of ``path``. At every moment one of the two, or ``path``.old, is whole."""
    fs, at = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    fs.delete(at(path + ".old"), True)
    fs.rename(at(path), at(path + ".old"))
    fs.rename(at(path + ".next"), at(path))
    fs.delete(at(path + ".old"), True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash within a swap: the new table if it was written whole, else the old one."""
    if _exists(spark, path):
        return
    at = spark._jvm.org.apache.hadoop.fs.Path
    for name in (path + ".next", path + ".old"):
        if _exists(spark, name + "/_SUCCESS"):
            _files(spark, path).rename(at(name), at(path))
            return


def clear(spark: SparkSession, path: str) -> None:
    """An empty table in place of the entries."""
    spark.read.parquet(path).limit(0).write.mode("overwrite").parquet(path + ".next")
    _swap(spark, path)
    _files(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path + ".used"), True)
