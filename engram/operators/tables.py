"""Table jobs: load, layout, append with schema changes, discovery, extract, copy, shards, head, policies, views, inserts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from engram.operators import ordered as o
from engram.session import materialise

CORRUPT = "_corrupt_record"


def load_table(
    spark: SparkSession, paths: str | Sequence[str], fmt: str, schema: T.StructType | str | None = None, delimiter: str = ",",
    quote: str = '"', skip_rows: int = 0, null_marker: str | None = None, jagged: bool = False, ignore_unknown: bool = False,
    max_bad: int = 0,
) -> DataFrame:
    """Read CSV, JSON lines, Parquet or ORC. More than `max_bad` unreadable rows fail the load; fewer are left out.

    Avro has no reader in a plain Spark distribution and is refused.
    """
    if skip_rows > 1:
        raise ValueError("one header row can be skipped; more rows have no meaning in split files")
    fmt = fmt.lower()
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt in ("parquet", "orc"):
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema is not None else reader).load(paths)
    if fmt not in ("csv", "json"):
        raise ValueError(f"format {fmt} is not supported")
    if schema is None:
        probe = spark.read.options(header=skip_rows > 0, sep=delimiter, quote=quote) if fmt == "csv" else spark.read
        schema = probe.option("inferSchema", True).format(fmt).load(paths).schema
    fields = (T.DataType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    full = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if fmt == "json":
        df = reader.json(paths)
        bad = F.col(CORRUPT).isNotNull()
    else:
        reader = reader.options(sep=delimiter, quote=quote, enforceSchema=True)
        if null_marker is not None:
            reader = reader.option("nullValue", null_marker)
        if skip_rows == 1:
            df = reader.option("header", True).csv(paths)
        else:
            df = reader.csv(paths)
        # a row that is too short or too long counts as corrupt too; both can be allowed
        # (delimiters within quotes don't part cells)
        q = re.escape(quote)
        bare = F.regexp_replace(CORRUPT, f"{q}(?:[^{q}]|{q}{q})*{q}", "") if quote else F.col(CORRUPT)
        cells = F.size(F.split(bare, re.escape(delimiter), -1))
        bad = F.col(CORRUPT).isNotNull()
        if jagged:
            bad = bad & ~(cells < len(fields))
        if ignore_unknown:
            bad = bad & ~(cells > len(fields))
    names = [f.name for f in fields]
    checked = materialise(df)
    if checked.filter(bad).count() > max_bad:
        raise ValueError(f"more than {max_bad} bad records")
    return checked.filter(~bad).select(*names)


UNITS = {"HOUR": "yyyy-MM-dd-HH", "DAY": "yyyy-MM-dd", "MONTH": "yyyy-MM", "YEAR": "yyyy"}


def layout(
    df: DataFrame, time_field: str | None = None, unit: str = "DAY", range_spec: str | None = None, cluster: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """Add the partition column of a time or integer-range partitioning and cluster the rows.

    `range_spec` is `field,start,end,interval`; values outside go to `__UNPARTITIONED__`, nulls to `__NULL__`.
    Rows are range partitioned by (partition, clustering columns), so a busy partition spreads over several tasks.
    """
    parts = []
    if time_field:
        parts.append("_part_time")
        df = df.withColumn("_part_time", F.coalesce(F.date_format(time_field, UNITS[unit.upper()]), F.lit("__NULL__")))
    if range_spec:
        bits = range_spec.split(",")
        if len(bits) != 4:
            raise ValueError("range partitioning is field,start,end,interval")
        name, start, end, step = bits[0], *map(int, bits[1:])
        value = F.col(name)
        bucket = (F.floor((value - start) / step) * step + start).cast("string")
        inside = (value >= start) & (value < end)
        parts.append("_part_range")
        df = df.withColumn("_part_range", F.when(value.isNull(), "__NULL__").when(inside, bucket).otherwise("__UNPARTITIONED__"))
    keys = [*parts, *cluster]
    if keys:
        # the row hash splits equal keys, so a partition value with most of the rows still spreads
        df = df.repartitionByRange(*keys, F.xxhash64(*df.columns)).sortWithinPartitions(*keys)
    return df, parts


def append_evolve(target: DataFrame, new: DataFrame, allow_new: bool = False, relax: bool = False) -> DataFrame:
    """Append rows whose schema differs: new columns and missing required columns only when allowed."""
    have, come = {f.name: f for f in target.schema}, {f.name: f for f in new.schema}
    added = [n for n in come if n not in have]
    if added and not allow_new:
        raise ValueError(f"new columns need allow_new: {added}")
    missing = [n for n, f in have.items() if n not in come and not f.nullable]
    looser = [n for n, f in have.items() if n in come and not f.nullable and come[n].nullable]
    if (missing or looser) and not relax:
        raise ValueError(f"required columns need relax: {missing + looser}")
    for name in have.keys() & come.keys():
        if have[name].dataType != come[name].dataType:
            raise ValueError(f"type of {name} differs")
    return target.unionByName(new, allowMissingColumns=True)


def discover(spark: SparkSession, path: str | Sequence[str], mode: str = "AUTO", fmt: str = "parquet") -> DataFrame:
    """Hive-style folders (`AUTO` typed, `STRINGS` as text), or a `MANIFEST` that lists one file per line."""
    if mode == "MANIFEST":
        listed = spark.read.text(path).filter("trim(value) <> ''")
        files = [r[0].strip() for r in listed.toLocalIterator()]  # file names, not data
        return spark.read.format(fmt).load(files)
    reader = spark.read.format(fmt).option("basePath", path if isinstance(path, str) else path[0])
    if mode == "STRINGS":
        key = "spark.sql.sources.partitionColumnTypeInference.enabled"
        before = spark.conf.get(key)
        spark.conf.set(key, "false")
        try:
            return reader.load(path)
        finally:
            spark.conf.set(key, before)
    return reader.load(path)


def extract(df: DataFrame, path: str, fmt: str = "csv", compression: str = "none", header: bool = True, delimiter: str = ",") -> None:
    """Write a table out. CSV has no nested columns."""
    fmt = fmt.lower()
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if fmt == "csv" and nested:
        raise ValueError(f"nested columns in CSV: {nested}")
    writer = df.write.mode("overwrite").option("compression", compression.lower())
    if fmt == "csv":
        writer.options(header=header, sep=delimiter).csv(path)
    elif fmt in ("json", "parquet"):
        writer.format(fmt).save(path)
    else:
        raise ValueError(f"format {fmt} is not supported")


def copy_table(spark: SparkSession, sources: Sequence[str], target: str, mode: str = "append") -> None:
    """Copy parquet tables into one: append, overwrite, or nothing when the target exists (`no_clobber`)."""
    out = None
    for path in sources:
        part = spark.read.parquet(path)
        out = part if out is None else out.unionByName(part)
    out.write.mode({"append": "append", "no_clobber": "ignore", "overwrite": "overwrite"}[mode]).parquet(target)


SHARD = re.compile(r"^(.*?)(\d{4}(?:\d{2}){0,3})$")


def merge_shards(shards: Mapping[str, DataFrame], prefix: str) -> DataFrame:
    """Date-sharded tables (`<prefix>YYYY[mm[dd[HH]]]`) as one table with the suffix as `partition_id`."""
    out = None
    for name, df in shards.items():
        found = SHARD.match(name)
        if not found or found.group(1) != prefix:
            continue
        part = df.withColumn("partition_id", F.lit(found.group(2)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no shard starts with {prefix}")
    return out


def read_shards(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """The date-sharded parquet folders `<prefix>YYYY[mm[dd[HH]]]` below `root` in one scan, with the suffix of each row's
    folder as `partition_id`. Columns that only some shards have are null elsewhere."""
    suffix = F.regexp_extract("_metadata.file_path", rf"{re.escape(prefix)}(\d{{4}}(?:\d{{2}}){{0,3}})/[^/]*$", 1)
    df = spark.read.option("mergeSchema", True).parquet(f"{root}/*{prefix}[0-9]*")
    return df.withColumn("partition_id", suffix).filter("partition_id <> ''")


def head(df: DataFrame, order: Sequence[str], start: int = 0, n: int = 100, fields: Sequence[str] = ()) -> DataFrame:
    """Rows start … start+n in the given order, with chosen (also nested) fields."""
    page = df.orderBy(*order).offset(start).limit(n)
    return page.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields]) if fields else page


def policy_view(df: DataFrame, policies: Mapping[str, Mapping], grantee: str) -> DataFrame:
    """Rows that any policy of a grantee makes visible: {name: {grantees: [...], predicate: sql}}.

    No policy at all leaves the table open; policies without one for the grantee hide every row.
    """
    if not policies:
        return df
    mine = [p["predicate"] for p in policies.values() if grantee in p["grantees"]]
    return df.filter(" OR ".join(f"({p})" for p in mine) if mine else "false")


def make_view(spark: SparkSession, name: str, sql: str, materialised: str | None = None) -> DataFrame:
    """A temp view of a query, or with a path its stored result; call again to refresh."""
    df = spark.sql(sql)
    if materialised:
        df.write.mode("overwrite").parquet(materialised)
        df = spark.read.parquet(materialised)
    df.createOrReplaceTempView(name)
    return df


READ_BY_LIST = 1_000  # changed partitions that a scan gets as a list; more are joined


def refresh_view(spark: SparkSession, table: str, view: str, partition: str, by: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Counts and sums of a partitioned parquet table by some columns, kept up to date partition by partition.

    The view stores partial results per partition of the table, and an index of which files each was made from and where its
    newest result lies. A refresh lists the files, reads the partitions whose files have changed and adds their results as a
    new version; removed partitions leave the index. The index is written last, so a refresh that fails changes nothing.
    """
    raw = F.regexp_extract("path", rf"/{re.escape(partition)}=([^/]*)/", 1)
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(table)
    # only names, sizes and times are read
    found = files.select(F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))).alias("part"), F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    now = found.groupBy("part").agg(F.concat_ws(":", F.count(F.lit(1)), F.sum("h")).alias("made_of"))
    try:
        old = spark.read.parquet(f"{view}/index")
        number = old.agg(F.max("v")).first()[0] + 1
        old = old.filter(F.col("v") == number - 1).select("part", F.col("made_of").alias("_before"), F.col("at").alias("_at"))
    except AnalysisException:  # the first refresh
        number, old = 0, spark.createDataFrame([], "part STRING, _before STRING, _at INT")
    both = now.join(old, "part", "left")
    same = F.coalesce(F.col("made_of") == F.col("_before"), F.lit(False))
    index = materialise(both.select("part", "made_of", F.when(same, F.col("_at")).otherwise(F.lit(number)).cast("int").alias("at")))
    changed = index.filter(F.col("at") == number).select("part")
    source = spark.read.parquet(table).withColumn("_part", F.col(partition).cast("string"))
    listed = [r[0] for r in changed.limit(READ_BY_LIST + 1).collect()]
    rows = source.filter(F.col(partition).cast("string").isin(listed)) if len(listed) <= READ_BY_LIST else source.join(changed, F.col("_part") == F.col("part"), "left_semi")
    if listed:
        partial = rows.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in sums])
        partial.withColumnRenamed("_part", "part").write.mode("overwrite").parquet(f"{view}/rows/at={number}")
    index.write.mode("overwrite").parquet(f"{view}/index/v={number}")
    kept = spark.read.parquet(f"{view}/rows").join(index.select("part", "at"), ["part", "at"], "left_semi")
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums])


def insert_rows(
    rows: DataFrame, schema: str, json: str = "json", insert_id: str | None = "insert_id", ignore_unknown: bool = False,
    required: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Rows from JSON text: (valid rows, invalid rows with a reason); one row per insert id.

    Unknown fields are an error unless ignored; a value that does not fit its type is an error.
    """
    fields = T.DataType.fromDDL(schema).fields
    names = F.array(*[F.lit(f.name) for f in fields])
    parsed = rows.withColumn("_r", F.from_json(json, schema, {"mode": "PERMISSIVE"}))
    raw = F.from_json(json, "map<string,string>")
    keys = F.coalesce(F.map_keys("_raw"), F.array().cast("array<string>"))
    misfit = F.lit(False)
    for f in fields:
        given = F.col("_raw")[f.name]
        misfit = misfit | (given.isNotNull() & F.col("_r")[f.name].isNull())
    absent = F.lit(False)
    for name in required:
        absent = absent | F.col("_r")[name].isNull()
    reason = (
        F.when(~F.coalesce(F.try_parse_json(json).isNotNull(), F.lit(False)), "not JSON")
        .when(F.size(F.array_except(keys, names)) > 0 if not ignore_unknown else F.lit(False), "unknown field")
        .when(F.coalesce(misfit, F.lit(False)), "wrong type")
        .when(F.coalesce(absent, F.lit(False)), "missing field")
    )
    judged = parsed.withColumn("_raw", raw).withColumn("reason", reason)
    extra = [insert_id] if insert_id else []
    good = judged.filter("reason IS NULL").select(*extra, "_r.*")
    if insert_id:
        good = good.dropDuplicates([insert_id])
    return good, judged.filter("reason IS NOT NULL").select(*extra, json, "reason")


def latency_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, population deviation and the 50th and 90th percentile with linear interpolation (exact).

    Percentiles are picked by rank from sorted runs, so no group has to fit into one buffer.
    """
    v, by = F.col(value), list(by)
    totals = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"))
    ranked = o.ordinals(df.filter(v.isNotNull()).select(*by, v.cast("double").alias("_v")), ["_v"], "_rank", by)
    sizes = totals.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("n").alias("_n"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    placed = ranked.join(sizes, same)

    def picked(share: float) -> Column:
        at = F.lit(share) * (F.col("_n") - 1)
        part = at - F.floor(at)
        low, high = F.col("_rank") == F.floor(at), F.col("_rank") == F.floor(at) + 1
        return F.sum(F.when(low, F.col("_v") * (1 - part)).when(high & (part > 0), F.col("_v") * part))

    ranks = placed.groupBy(*by).agg(picked(0.5).alias("p50"), picked(0.9).alias("p90")).select(*[F.col(k).alias(f"_k_{k}") for k in by], "p50", "p90")
    return totals.join(ranks, same, "left").select(*by, "n", "mean", "stddev", "p50", "p90")
