"""Reading and writing the usage fact and the price dimension.

The native store is Parquet partitioned by ``usage_date`` so that every
time-windowed monitor prunes whole directories; CSV is supported for the
exported sample format (JSON quotes doubled, hence ``escape='"'``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.costing import PriceIndex
from ..plans.session import materialize
from ..schema import COSTED_USAGE_SCHEMA, MONEY, RATE, USAGE_SCHEMA


CSV_TIMES = "yyyy-MM-dd HH:mm:ss.SSSSSS"
BAD_RECORD = "_bad_record"
NO_VALUE = "\0"  # what the parser hands on for a field without a character


def read_usage_csv(spark: SparkSession, path: str, with_cost: bool = True) -> DataFrame:
    """Headered CSV with the fixed schema (no inference).  Rows that do not fit it are read
    as far as they do; ``scan_usage_csv`` tells them apart."""
    schema = COSTED_USAGE_SCHEMA if with_cost else USAGE_SCHEMA
    return (spark.read.schema(schema)
            .option("header", True)
            .option("escape", '"')
            .option("mode", "PERMISSIVE")
            .csv(path))


def scan_usage_csv(spark: SparkSession, path: str, with_cost: bool = True,
                   times: str | None = CSV_TIMES) -> DataFrame:
    """Every record of a headered CSV folder: the usage columns, ``_bad_record`` (the raw
    record where it does not fit the schema, else NULL) and ``_file``.

    Records may span lines inside quotes (a JSON document with line feeds); the files are
    therefore not split, so write many of moderate size.  Header names are not compared;
    a record with too few or too many fields, or a field that does not parse, is bad.  A
    record without an id is bad as well.
    """
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in
                           (COSTED_USAGE_SCHEMA if with_cost else USAGE_SCHEMA).fields]
                          + [T.StructField(BAD_RECORD, T.StringType(), True)])
    reader = (spark.read.schema(schema)
              .option("header", True).option("escape", '"').option("multiLine", True)
              .option("emptyValue", "").option("nullValue", NO_VALUE)  # "" is not NULL
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD))
    if times:
        reader = reader.option("timestampFormat", times)
    rows = reader.csv(path)
    no_id = F.col("usage_record_id").isNull() & F.col(BAD_RECORD).isNull()
    return rows.select(*[c for c in rows.columns if c != BAD_RECORD],
                       F.when(no_id, F.lit("no record id")).otherwise(F.col(BAD_RECORD))
                       .alias(BAD_RECORD),
                       F.col("_metadata.file_path").alias("_file"))


def import_usage_csv(spark: SparkSession, path: str, usage_path: str, quarantine_path: str,
                     with_cost: bool = True, times: str | None = CSV_TIMES) -> dict[str, int]:
    """CSV folder to a usage table; bad records go to ``quarantine_path`` as (record, file).

    Returns the records read, good and bad as observed while writing, in one scan: the
    scan is landed once, split by whether the record is bad, and both parts are written
    from there.  ``read`` is ``good + bad``; a caller can hold it against the source.
    """
    rows = scan_usage_csv(spark, path, with_cost, times)
    landed = f"{quarantine_path.rstrip('/')}/scan"
    seen = Observation("csv_scan")
    (rows.observe(seen, F.count(F.lit(1)).alias("read"),
                  F.count(BAD_RECORD).alias("bad"))
     .write.mode("overwrite").parquet(landed))
    scan = spark.read.schema(rows.schema).parquet(landed)
    write_usage(scan.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD, "_file"), usage_path)
    (scan.where(F.col(BAD_RECORD).isNotNull())
     .select(F.col(BAD_RECORD).alias("record"), F.col("_file").alias("file"))
     .write.mode("overwrite").parquet(f"{quarantine_path.rstrip('/')}/bad"))
    counts = seen.get
    return {"read": counts["read"], "good": counts["read"] - counts["bad"], "bad": counts["bad"]}


def read_usage_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet usage table, projected and typed to the usage schema.

    A ``usage_date`` partition column and an ``estimated_cost_usd`` column are
    kept when present.  Passing ``schema`` skips the footer-inference job.
    """
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in USAGE_SCHEMA.fields]
    if "estimated_cost_usd" in df.columns:
        cols.append(F.col("estimated_cost_usd").cast(MONEY).alias("estimated_cost_usd"))
    if "usage_date" in df.columns:
        cols.append(F.col("usage_date"))
    return df.select(*cols)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price periods (sku_name, pricing.default, price_start_time,
    price_end_time); other fields of the ``pricing`` struct are ignored."""
    df = spark.read.parquet(path)
    return df.select(
        F.col("sku_name").cast("string").alias("sku_name"),
        F.struct(F.col("pricing.default").cast(RATE).alias("default")).alias("pricing"),
        F.col("price_start_time").cast("timestamp").alias("price_start_time"),
        F.col("price_end_time").cast("timestamp").alias("price_end_time"))


def write_price_index(index: PriceIndex, path: str, mode: str = "error") -> None:
    """The price index as two Parquet tables, sorted by SKU."""
    index.dated.sortWithinPartitions("_p_sku", "_p_bucket").write.mode(mode).parquet(f"{path}/dated")
    index.standing.sortWithinPartitions("_s_sku").write.mode(mode).parquet(f"{path}/standing")


def read_price_index(spark: SparkSession, path: str) -> PriceIndex:
    return PriceIndex(spark.read.schema(PriceIndex.DATED).parquet(f"{path}/dated"),
                      spark.read.schema(PriceIndex.STANDING).parquet(f"{path}/standing"))


def record_id(schema: T.StructType) -> Column:
    """UUID-formatted start of the SHA-256 over every column of ``schema``, taken in name
    order as ``name=length:value`` (``name-`` for a NULL), so that no two different records
    share the digested text.  Timestamps count as microseconds since the epoch, whatever the
    session time zone; nested values as JSON."""
    def part(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.TimestampType):
            v = F.unix_micros(f.name).cast("string")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            v = F.to_json(f.name)
        else:
            v = F.col(f.name).cast("string")
        return F.when(v.isNull(), F.lit(f"{f.name}-")).otherwise(
            F.concat(F.lit(f"{f.name}="), F.length(v).cast("string"), F.lit(":"), v))
    h = F.sha2(F.concat(*[part(f) for f in sorted(schema.fields, key=lambda f: f.name)]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def with_record_ids(usage: DataFrame, column: str = "usage_record_id",
                    ignore: tuple[str, ...] = ()) -> DataFrame:
    """``usage`` with UUID-formatted record ids digested from all of its other columns
    (but those to ``ignore``, such as a number that the delivery gave the record).

    Different records differ in a column and so in their id, down to the metadata: two
    clusters of one workspace, SKU, hour and quantity are told apart.  Copies of a record
    share its id, which the duplicate-id gate then reports.  Name-based rather than
    random: a task recomputed after a lost executor produces the same ids.  No shuffle.
    """
    return usage.withColumn(column, record_id(usage.drop(column, *ignore).schema))


COPIES_AT_ONCE = 8192  # copies of one record that one task lists


def list_copies(counted: DataFrame, key: str, n_col: str, occurrence: str) -> DataFrame:
    """A row per copy of records that carry their count, with ``occurrence`` 0, 1, ...  The
    copies of a record that has many are listed in slices, dealt out by ``key`` and slice."""
    n = F.col(n_col)
    few = counted.where(n <= COPIES_AT_ONCE).withColumn(
        occurrence, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("_slice") * COPIES_AT_ONCE
    many = (counted.where(n > COPIES_AT_ONCE)
            .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.expr(f"({n_col} - 1) div {COPIES_AT_ONCE}"))))
            .repartition(key, "_slice")
            .withColumn(occurrence, F.explode(F.sequence(start, F.least(start + COPIES_AT_ONCE, n) - 1)))
            .drop("_slice"))
    return few.unionByName(many).drop(n_col)


def number_records(usage: DataFrame, id_col: str = "usage_record_id",
                   time_col: str = "usage_start_time") -> DataFrame:
    """The whole table in time order: ``usage`` with record ids in ``id_col``, an
    ``occurrence`` number among the copies of a record (0 first) and ``record_seq``, the
    row's place in the table sorted by time, record id and occurrence (NULL times first).

    Copies are first counted, combining on the map side, so that a record delivered any
    number of times travels as one row.  One range-partitioned sort on (time, id,
    occurrence), which no two rows share, then spreads rows evenly whatever their times; a
    row's number is its place in its partition plus the rows of the partitions before,
    which are one row per partition.  The sorted rows are checkpointed in the shared
    folder, so a lost executor does not number rows anew.  Reruns give the same numbers.
    """
    rows = usage.drop(id_col)
    order = [time_col, id_col, "occurrence"]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    ids = counted.select(record_id(rows.schema).alias(id_col), "*")
    listed = list_copies(ids, id_col, "_n", "occurrence")
    sort = materialize(listed.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    sizes = (sort.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
             .select("_part", before.alias("_before")))  # one row per partition of the sort
    seq = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (sort.withColumn("_part", part).join(F.broadcast(sizes), "_part")
            .withColumn("record_seq", seq).drop("_part", "_at", "_before"))


def write_usage(df: DataFrame, path: str, mode: str = "overwrite",
                max_records_per_file: int = 5_000_000, partitions: int | None = None) -> None:
    """Parquet partitioned by ``usage_date`` and sorted over the whole table by (day, SKU,
    start time, workspace).

    The rows are range-partitioned on that key and on a hash of the row, so that neither a
    large day nor a hot (day, SKU, hour) becomes one task.  Each task writes a contiguous
    stretch of the key: files of a day have disjoint key ranges, which lets Parquet
    statistics skip whole files, and there are at most (partitions + days) files plus one
    per ``max_records_per_file``.  Without ``partitions`` the session's shuffle partitions
    are used, which adaptive execution joins up to its advisory size.
    """
    key = ["usage_date", "sku_name", "usage_start_time", "workspace_id", "_spread"]
    rows = (df.withColumn("usage_date", F.to_date("usage_start_time"))
            .withColumn("_spread", F.xxhash64(*df.columns, F.monotonically_increasing_id())))
    ranged = (rows.repartitionByRange(partitions, *key) if partitions
              else rows.repartitionByRange(*key))
    (ranged.sortWithinPartitions(*key).drop("_spread")
     .write.mode(mode)
     .option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("usage_date")
     .parquet(path))


def write_usage_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headered CSV export in the sample's format: JSON quotes doubled, NULL left empty, an
    empty string as ``""`` (so that the two are told apart when read back)."""
    (df.write.mode(mode)
       .option("header", True)
       .option("escape", '"')
       .option("emptyValue", '""')
       .option("nullValue", "")
       .option("ignoreLeadingWhiteSpace", False)
       .option("ignoreTrailingWhiteSpace", False)
       .option("timestampFormat", CSV_TIMES)
       .csv(path))


PARTITIONED_USAGE_SCHEMA = T.StructType(USAGE_SCHEMA.fields + [T.StructField("usage_date", T.DateType())])


def write_table_once(spark: SparkSession, build, path: str, writer) -> str:
    """Write ``build()`` to ``path`` unless a complete copy is already there
    (the DataFrame is only built when it has to be written).

    The data goes to a sibling temporary folder first and is renamed into
    place, so readers never see a half-written table and a job retried after
    a lost executor simply rewrites the temporary folder."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        return path
    tmp = f"{path}.tmp-{uuid.uuid4().hex}"
    writer(build(), tmp)
    if fs.exists(hpath) and not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        fs.delete(hpath, True)  # left over from an interrupted run
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(tmp), hpath):
        fs.delete(jvm.org.apache.hadoop.fs.Path(tmp), True)  # another writer won
    return path
