"""Reading telemetry files of several formats, catalogues of them, and tables with forbidden columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rootloom.sources.footers import footer_ranges, opens


def scan_metrics(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """CSV (with header), JSON lines or Parquet by the paths' ends; damaged files and lines are passed over."""
    out = None
    for kind in ("csv", "json", "parquet"):
        mine = [p for p in paths if p.rstrip("/").endswith("." + kind)]
        if mine:
            reader = spark.read.option("ignoreCorruptFiles", "true").option("mode", "PERMISSIVE")
            reader = reader.schema(schema) if schema else reader
            df = reader.option("header", "true").csv(mine) if kind == "csv" else reader.json(mine) if kind == "json" else reader.parquet(*mine)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no path ends in .csv, .json or .parquet")
    return out


#: Names of a case's metric file, best first.
METRIC_FILES = ("simple_metrics.csv", "simple_data.csv", "data.csv", "metrics.json", "metrics.csv")


def metric_file_choice(files: DataFrame) -> DataFrame:
    """(case_id, file): the first of the known names that each case has."""
    rank = F.array_position(F.array(*map(F.lit, METRIC_FILES)), F.col("file"))
    known = files.withColumn("_rank", rank).where("_rank > 0")
    return known.groupBy("case_id").agg(F.min_by("file", "_rank").alias("file"))


def case_labels(cases: DataFrame, label: str = "label") -> DataFrame:
    """(case_id, true_root, fault_type): the label parted at its last underscore."""
    part = lambda k: F.regexp_extract(label, "^(.*)_([^_]*)$", k)
    return cases.select("case_id", part(1).alias("true_root"), part(2).alias("fault_type"))


def inject_time(text: Column) -> Column:
    """Whole seconds of a number in a text file; null where it isn't one."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("bigint"))


def infer_modality(path: Column) -> Column:
    """The modality of a file, from its name and its folder's, whatever the letters' case; files that tell nothing are events."""
    name, folder = F.lower(F.substring_index(path, "/", -1)), F.lower(F.element_at(F.split(F.concat(F.lit("/"), path), "/"), -2))
    either = lambda word: name.contains(word) | folder.contains(word)
    # The words, their order, and the names without a word.
    metrics = either("metric") | name.isin("data.csv", "simple_data.csv")
    traces = either("trace") | name.contains("span")
    return F.when(metrics, "metrics").when(traces, "traces").when(either("log"), "logs").when(name.endswith(".json"), "auxiliary").otherwise("events")


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Files, bytes and rows of each modality, and of all (modality ``all``)."""
    sums = (F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.sum("rows").cast("long").alias("rows"), F.grouping("modality").alias("_all"))
    return catalog.rollup("modality").agg(*sums).withColumn("modality", F.when(F.col("_all") == 1, "all").otherwise(F.col("modality"))).drop("_all")


#: Ends of the names of telemetry files.
SUPPORTED = (".csv", ".parquet", ".json", ".log", ".txt")


def list_files(spark: SparkSession, folder: str, glob: str = "*", hashed: bool = False) -> DataFrame:
    """(path, bytes, modality, modified) of all supported files below a folder; no file is read, unless ``hashed`` adds the sha256 of each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    supported = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1))).isin(*SUPPORTED)
    return files.where(supported).select("path", F.col("length").alias("bytes"), infer_modality(F.col("path")).alias("modality"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def csv_ranges(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, n_rows, time_column, start_time, end_time) of CSV files, each with its own header; commas within quotes before the time column aren't known.

    A file's header is its first line: that of its first split with the least row number, so large files are split as usual.
    """
    from rootloom.operators.time_ops import coerce_time, ts_column

    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.rtrim("value").alias("line"), place.alias("place")).where("line <> ''")
    heads = lines.groupBy("path").agg(F.min_by("line", "place").alias("head"), F.min("place").alias("first"), (F.count("*") - 1).alias("n_rows"))
    names = F.transform(F.split("head", ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    heads = heads.withColumn("time_column", ts_column(names)).withColumn("at", F.array_position(names, F.col("time_column")).cast("int"))
    # One row for each file: the heads are few beside the lines.
    cells = lines.join(heads.where("at > 0").select("path", "first", "at"), "path").where("place <> first").select("path", F.try_element_at(F.split("line", ","), F.col("at")).alias("raw"))
    times = coerce_time(cells, "raw", ["path"], "ts").groupBy("path").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    return heads.join(times, "path", "left").select("path", "n_rows", "time_column", "start_time", "end_time")


def parquet_ranges(spark: SparkSession, folder: str, times: str = "", glob: str = "*.parquet") -> DataFrame:
    """(path, n_rows, time_column, start_time, end_time) of Parquet files. ``times``: name and stored type of the columns that may
    hold the time, in order (``ts timestamp_ntz, start double``); the first that a file has values of is taken. Numbers stay as they are; other
    columns aren't read.
    """
    schema = "_nothing int" + (", " + times if times else "")
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).schema(schema).parquet(folder)
    number = lambda f: F.unix_micros(F.col(f.name).cast("timestamp")) / 1e6 if f.dataType.typeName().startswith("timestamp") else F.col(f.name).cast("double")
    found = rows.schema.fields[1:]
    ends = [F.struct(F.lit(f.name).alias("c"), F.min(number(f)).alias("a"), F.max(number(f)).alias("b")) for f in found]
    grouped = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"), F.array(*ends).cast("array<struct<c:string,a:double,b:double>>").alias("ends"))
    first = F.get(F.filter("ends", lambda e: e["a"].isNotNull()), 0)
    return grouped.select("path", "n_rows", first["c"].alias("time_column"), first["a"].alias("start_time"), first["b"].alias("end_time"))


def schema_ranges(spark: SparkSession, files: DataFrame) -> DataFrame:
    """As ``footer_ranges``, for file systems that only Spark's readers can open: (path, ...) of the Parquet files ``files``.

    The driver asks each file's schema, one after another, and files of the same time column and type are read by one job. Where files are very
    many, name the columns instead (``parquet_ranges``). Texts are read as numbers, else as times; columns of other types have no range. A file
    that Spark can't read, damaged or of types it doesn't know, has no row.
    """
    from pyspark.errors import PySparkException

    from rootloom.operators.time_ops import choose_ts_column

    groups: dict[tuple[str | None, str], list[str]] = {}
    for row in files.select("path").toLocalIterator():
        try:
            schema = spark.read.option("ignoreCorruptFiles", "true").parquet(row["path"]).schema
        except PySparkException:
            continue
        name = choose_ts_column(schema.names)
        groups.setdefault((name, schema[name].dataType.simpleString() if name else ""), []).append(row["path"])
    out = spark.createDataFrame([], "path string, n_rows long, time_column string, start_time double, end_time double")
    for (name, kind), paths in groups.items():
        rows, at = spark.read.parquet(*paths) if name is None else spark.read.schema(f"`{name}` {kind}").parquet(*paths), F.lit(None).cast("double")
        if name is not None and kind.startswith(("timestamp", "date")):
            at = F.unix_micros(F.col(f"`{name}`").cast("timestamp")) / 1e6
        elif name is not None and kind == "string":
            at = F.coalesce(F.col(f"`{name}`").try_cast("double"), F.unix_micros(F.col(f"`{name}`").try_cast("timestamp")) / 1e6)
        elif name is not None and not kind.startswith(("array", "map", "struct", "binary", "boolean", "variant")):
            at = F.col(f"`{name}`").cast("double")
        rows = rows.select(F.col("_metadata.file_path").alias("path"), F.when(~F.isnan(at), at).alias("_t"))
        ends = rows.groupBy("path").agg(F.count("*").alias("n_rows"), F.min("_t").alias("start_time"), F.max("_t").alias("end_time"))
        out = out.union(ends.select("path", "n_rows", F.lit(name).alias("time_column"), "start_time", "end_time"))
    return out


def file_catalog(spark: SparkSession, folder: str, glob: str = "*", times: str = "", hashed: bool = False) -> DataFrame:
    """(path, bytes, modality, modified, n_rows, time_column, start_time, end_time) of all supported files below a folder.

    CSV files are read as lines, Parquet files at their footers (``footer_ranges``), or, where ``times`` names them, by these columns
    (``parquet_ranges``), or, on file systems that only Spark's readers know, by their schemas (``schema_ranges``); the others have no rows here. A file that can't be read keeps its row. An empty folder gives no rows.
    """
    found = list_files(spark, folder, glob, hashed)
    plain = lambda df: df.withColumn("_at", F.regexp_replace("path", "^file:/*", "/")).drop("path")  # noqa: E731  the readers write local paths in two ways
    kinds = {r["k"] for r in found.select(F.lower(F.element_at(F.split("path", r"\."), -1)).alias("k")).distinct().collect()}  # five at most
    ranges = [csv_ranges(spark, folder)] if "csv" in kinds else []
    if "parquet" in kinds:
        ranges.append(parquet_ranges(spark, folder, times) if times else footer_ranges(spark, folder) if opens(folder) else schema_ranges(spark, found.where("lower(path) like '%.parquet'")))
    if not ranges:
        return found.select("*", F.lit(0).cast("long").alias("n_rows"), F.lit(None).cast("string").alias("time_column"), *[F.lit(None).cast("double").alias(c) for c in ("start_time", "end_time")])
    known = plain(ranges[0] if len(ranges) == 1 else ranges[0].union(ranges[1]))
    rows = found.withColumn("_at", F.regexp_replace("path", "^file:/*", "/")).join(known, "_at", "left").drop("_at")
    return rows.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))


def table_catalog(catalog: DataFrame, folder: str, ending: str = ".parquet") -> DataFrame:
    """(name, modality, n_rows, time_column, start_time, end_time) of each table: a file, or all files below a folder of such a name, as Spark writes tables."""
    base = re.sub("^file:/*", "/", folder).rstrip("/") + "/"
    at = F.regexp_replace("path", "^file:/*", "/")
    below = F.when(at.startswith(base), F.substring(at, len(base) + 1, 1 << 30)).otherwise(at)
    name = F.regexp_extract(below, f"([^/]+{re.escape(ending)})(/.*)?$", 1)
    sums = [F.min("modality").alias("modality"), F.sum("n_rows").alias("n_rows"), F.min("time_column").alias("time_column"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")]
    return catalog.groupBy(name.alias("name")).agg(*sums)


def file_manifest(catalog: DataFrame) -> DataFrame:
    """(files, bytes, sha256): one hash over all (path, bytes), whatever their order.

    Each line's SHA-256 is cut into four numbers of 64 bits, which are summed; the hash is that of the count and the sums. So
    lines meet as sums, not as a list. A catalogue without files has the hash of a count of 0.
    """
    mark = F.sha2(F.concat_ws(":", "path", F.col("bytes").cast("string")), 256)
    number = lambda k: F.conv(F.substring(mark, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = catalog.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), *[F.coalesce(F.sum(number(k)), F.lit(0)).cast("decimal(38,0)").alias(f"s{k}") for k in range(4)])
    return sums.select("files", "bytes", F.sha2(F.concat_ws(":", F.col("files").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("sha256"))


def stale_manifest(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): files that are new, gone or changed."""
    a, b = stored.select("path", F.col("sha256").alias("_old")), current.select("path", F.col("sha256").alias("_new"))
    both = a.join(b, "path", "full_outer").where("not (_old <=> _new)")
    return both.select("path", F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").otherwise("changed").alias("state"))


def window_extract(rows: DataFrame, start_ts: float, end_ts: float, folder: str | None = None) -> DataFrame:
    """The rows of a time range, both ends included; with a folder, written there as CSV with a header."""
    hit = rows.where((F.col("ts") >= start_ts) & (F.col("ts") <= end_ts))
    if folder:
        hit.write.mode("overwrite").option("header", "true").csv(folder)
    return hit


def scan_tasks(df: DataFrame) -> DataFrame:
    """A task table without its scoring points; the required columns must be there."""
    missing = {"task_index", "instruction", "scoring_points"} - set(df.columns)
    if missing:
        raise ValueError(f"the task table lacks {sorted(missing)}")
    return df.drop("scoring_points")


def drop_forbidden(df: DataFrame, forbidden: Iterable[str]) -> DataFrame:
    """Without label columns, whatever the case of their letters."""
    names = {f.lower() for f in forbidden}
    return df.drop(*[x for x in df.columns if x.lower() in names])


LABEL_COLUMNS = ("true_root", "fault_type", "label", "root1", "root2", "root3", "scoring_points")


def label_safe(cases: DataFrame) -> DataFrame:
    return drop_forbidden(cases, LABEL_COLUMNS)


def scan_kpi_labels(labels: DataFrame) -> DataFrame:
    """Labels with violations counted: values other than 0 and 1, and rows without any root."""
    roots = [F.col(r) for r in ("root1", "root2", "root3")]
    binary = roots[0].isin(0, 1) & roots[1].isin(0, 1) & roots[2].isin(0, 1)
    return labels.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(binary, F.lit(False))).alias("not_binary"), F.count_if(roots[0] + roots[1] + roots[2] < 1).alias("without_root"), *[F.sum(r).cast("long").alias(n) for r, n in zip(roots, ("root1", "root2", "root3"), strict=True)])


def ranked_indicators(rows: DataFrame, json_col: str = "raw") -> DataFrame:
    """(key, rank, service) from JSON ``{"0": [indicator, ...]}``: the services in the order they first come."""
    items = rows.select("case_id", F.posexplode(F.from_json(json_col, "map<string,array<string>>")["0"]).alias("pos", "indicator"))
    service = F.regexp_replace(F.substring_index("indicator", "_", 1), "-db$", "")
    first = items.groupBy("case_id", service.alias("service")).agg(F.min("pos").alias("_pos"))
    return first.select("case_id", "service", F.row_number().over(Window.partitionBy("case_id").orderBy("_pos")).alias("rank"))


def pending_work(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work without a stored row of the same keys (a fingerprint among them)."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def suite_counts(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """(suite, expected, observed, ok) for each expected suite."""
    seen = cases.groupBy("suite").agg(F.count("*").alias("observed"))
    return expected.join(seen, "suite", "left").select("suite", "expected", F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), (F.coalesce("observed", F.lit(0)) == F.col("expected")).alias("ok"))


def scan_cases(paths: DataFrame) -> DataFrame:
    """(suite, root, fault, run) of directories ``RE[123]-*/<root>_<fault>/<n>/`` that have an injection file and a metric file."""
    parts = r"/(RE[123])-[^/]*/([^/]*)_([^/_]*)/(\d+)/([^/]+)$"
    cols = [F.regexp_extract("path", parts, k).alias(n) for k, n in enumerate(("suite", "root", "fault", "run", "file"), 1)]
    rows = paths.select(*cols).where("suite <> ''")
    has = lambda names: F.max(F.col("file").isin(*names))
    found = rows.groupBy("suite", "root", "fault", "run").agg(has(("inject_time.txt",)).alias("_i"), has(METRIC_FILES).alias("_m"))
    return found.where("_i and _m").select("suite", "root", "fault", F.col("run").cast("int").alias("run"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    import uuid

    from rootloom.session import shared_base

    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def write_partitioned(rows: DataFrame, folder: str, keys: list[str]) -> None:
    """zstd Parquet in a directory for each value of the keys; large values are dealt over several files."""
    rows.hint("rebalance", *keys).write.partitionBy(*keys).option("compression", "zstd").parquet(folder)


def write_results(rows: DataFrame, folder: str, kind: str = "parquet") -> None:
    rows.write.mode("overwrite").format(kind).save(folder)
