"""Alarm knowledge graphs: leaks of the answer, views, candidates, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootloom.session import written

#: Keys and values that give the answer away, letters and digits only.
FORBIDDEN_KEYS = ("groundtruth", "groundtruthrootcause", "correctanswer", "goldanswer", "isrootcause", "istargetrootcause")
FORBIDDEN_VALUES = ("targetrootcause", "groundtruth", "groundtruthrootcause", "correctanswer", "goldanswer")


def token(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]", "")


def _explode(level: DataFrame) -> DataFrame:
    """The members of each ``v`` of a level: the level's other columns, name (null in a list), pos, v, nested, and text of a scalar."""
    spark = level.sparkSession
    level.createOrReplaceTempView("_rootloom_level")
    others = ", ".join(f"t.{c} as {c}" for c in level.columns if c != "v")
    out = spark.sql(f"select {others}, e.key as name, e.pos, e.value as v, schema_of_variant(e.value) as kind from _rootloom_level t, lateral variant_explode(t.v) e")
    nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
    return out.withColumn("nested", nested).withColumn("text", F.when(~F.col("nested"), F.expr("try_variant_get(v, '$', 'string')")))


def _bad_key() -> Column:
    return token(F.col("name")).isin(*FORBIDDEN_KEYS)


def _bad_value() -> Column:
    """Of a field, not of a list's member."""
    return F.col("name").isNotNull() & token(F.col("text")).isin(*FORBIDDEN_VALUES)


def leakage_audit(graphs: DataFrame, key: str = "case_id", raw: str = "raw") -> DataFrame:
    """(key, path, kind, value) for each forbidden key or scalar value anywhere in a JSON document, one level at a time until none is left."""
    level, out = graphs.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(raw).alias("v")), None
    while True:
        found = _explode(level)
        inside = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "name"))
        found = found.withColumn("path", inside)
        hits = F.filter(F.array(F.when(_bad_key(), F.lit("answer_key")), F.when(_bad_value(), F.lit("answer_marker"))), lambda x: x.isNotNull())
        part = found.select(F.col("key").alias(key), "path", F.explode(hits).alias("kind"), F.coalesce("text", F.to_json("v"), F.lit("")).alias("value"))
        out = part if out is None else out.unionByName(part)
        level = written(found.where("nested").select("key", "path", "v"), "level")
        if level.isEmpty():
            return out


def sanitize_json(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the JSON documents in ``column`` without forbidden fields, at any depth, and all below them; lists keep their order.

    Different documents are taken apart level by level, and only those that hold something forbidden are put together again,
    from the deepest level up; all others stay as they are, and so does what is no JSON.
    """
    texts = written(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("raw")).distinct().select(F.sha2("raw", 256).alias("doc"), F.try_parse_json("raw").alias("v")), "documents")
    leaky = written(leakage_audit(texts.select("doc", F.to_json("v").alias("raw")), "doc").select("doc").distinct(), "leaky")
    # Of a level: where a member stands (its places from the top, joined), and what it is.
    levels = [written(texts.join(leaky, "doc", "left_semi").select("doc", F.lit("").alias("at"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("pos"), "v", F.schema_of_variant("v").alias("kind")), "level")]
    while not levels[-1].isEmpty():
        found = _explode(levels[-1].select("doc", "at", "v").withColumnRenamed("at", "above")).where(~F.coalesce(_bad_key(), F.lit(False)) & ~F.coalesce(_bad_value(), F.lit(False)))
        levels.append(written(found.select("doc", F.concat_ws("/", "above", F.col("pos").cast("string")).alias("at"), "name", "pos", "v", "kind"), "level"))
    built = None
    for level in reversed(levels):
        own = level.select("doc", "at", "name", "pos", "kind", F.to_json("v").alias("json"))
        if built is not None:
            own = own.join(built, ["doc", "at"], "left")
        else:
            own = own.withColumn("members", F.lit(None).cast("array<struct<pos:int,name:string,json:string>>"))
        # The name in quotes ends with the bracket of the list that it was escaped in.
        fields = F.array_join(F.transform("members", lambda m: F.concat(F.regexp_replace(F.to_json(F.array(m["name"])), r"^\[|\]$", ""), F.lit(":"), m["json"])), ",")
        items = F.array_join(F.transform("members", lambda m: m["json"]), ",")
        json = F.when(F.col("kind").startswith("OBJECT"), F.concat(F.lit("{"), F.coalesce(fields, F.lit("")), F.lit("}"))).when(F.col("kind").startswith("ARRAY"), F.concat(F.lit("["), F.coalesce(items, F.lit("")), F.lit("]"))).otherwise(F.col("json"))
        done = own.select("doc", "at", "name", "pos", json.alias("json"))
        member = F.struct(F.col("pos"), F.col("name"), F.col("json"))
        up = F.when(F.col("at").contains("/"), F.regexp_replace("at", "/[^/]*$", "")).otherwise(F.lit(""))
        built = written(done.where("at <> ''").groupBy("doc", up.alias("at")).agg(F.sort_array(F.collect_list(member)).alias("members")), "built")
    cleaned = done.select(F.col("doc").alias("_doc"), F.col("json").alias("_clean"))
    return rows.withColumn("_doc", F.sha2(column, 256)).join(cleaned, "_doc", "left").withColumn(column, F.coalesce("_clean", column)).drop("_doc", "_clean").select(*rows.columns)


def sanitize_props(rows: DataFrame, props: str = "props") -> DataFrame:
    """Without forbidden fields of a map column, and of the JSON objects and lists that its values hold."""
    kept = F.map_filter(props, lambda k, v: ~token(k).isin(*FORBIDDEN_KEYS) & ~F.coalesce(token(v).isin(*FORBIDDEN_VALUES), F.lit(False)))
    rows = written(rows.withColumn(props, kept).withColumn("_row", F.monotonically_increasing_id()), "props")
    inner = rows.select("_row", F.explode(F.map_entries(props)).alias("e")).select("_row", F.col("e.key").alias("k"), F.col("e.value").alias("json")).where(r"ltrim(json) rlike '^[\\{\\[]'")
    patch = sanitize_json(inner, "json").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("k", "json"))).alias("_patch"))  # of one row
    out = rows.join(patch, "_row", "left").withColumn(props, F.transform_values(props, lambda k, v: F.coalesce(F.try_element_at("_patch", k), v)))
    return out.drop("_row", "_patch")


def plain_kind(kind: Column) -> Column:
    return F.lower(F.replace(F.coalesce(kind, F.lit("")), F.lit("_"), F.lit("")))


def node_class(kind: Column) -> Column:
    """candidate, alarm or resource; a cause of alarms is a candidate."""
    text = plain_kind(kind)
    return F.when(text.contains("rootcause") | text.contains("alarmcause"), "candidate").when(text.contains("alarm"), "alarm").otherwise("resource")


def graph_view(nodes: DataFrame, edges: DataFrame, classes: tuple[str, ...], causal: bool = False) -> DataFrame:
    """Edges with both ends among nodes of the classes; ``causal``: and causal edges with one end there. nodes: (case_id, rid, class); edges: (case_id, src, dst, relation)."""
    chosen = nodes.where(F.col("class").isin(*classes)).select("case_id", "rid").distinct()
    ends = edges
    for side in ("src", "dst"):
        mark = chosen.select("case_id", F.col("rid").alias(side), F.lit(True).alias(f"_{side}"))
        ends = ends.join(mark, ["case_id", side], "left")
    a, b = (F.coalesce(f"_{s}", F.lit(False)) for s in ("src", "dst"))
    keep = a & b
    if causal:
        keep = keep | (F.lower("relation").contains("caus") & (a | b))
    return ends.where(keep).select("case_id", "src", "dst", "relation")


def first_name(props: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(props, F.lit(k))), F.lit("")) for k in keys])


def kg_candidates(nodes: DataFrame) -> DataFrame:
    """(case_id, name, rank): names of cause nodes, once each, in the order they come (``pos``)."""
    causes = nodes.where(node_class(F.col("kind")) == "candidate").withColumn("name", first_name(F.col("props"), ("title", "causeName", "evalCause", "cause_description"))).where("name is not null")
    first = causes.groupBy("case_id", "name").agg(F.min("pos").alias("_pos"))
    from pyspark.sql import Window

    return first.select("case_id", "name", F.row_number().over(Window.partitionBy("case_id").orderBy("_pos")).alias("rank"))


def root_labels(nodes: DataFrame) -> DataFrame:
    """(case_id, name): the first name of each node that is marked as a root cause."""
    marked = plain_kind(F.col("kind")).contains("rootcause") | F.exists("labels", lambda x: F.lower(x) == "rootcause")
    return nodes.where(marked).select("case_id", first_name(F.col("props"), ("causeName", "evalCause", "title", "cause_description")).alias("name")).where("name is not null").distinct()


def scan_graph_json(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, graph, label, sha256): each ``input.json`` with the ``label.json`` beside it, or ``<case>_input.json`` with ``<case>_label.json``; the hash is of the input's bytes.

    Cases are named by their directory, flat files by what stands before the underscore. A file without its other is left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder)
    name, place = F.substring_index("path", "/", -1), F.regexp_replace("path", "/[^/]*$", "")
    kind = F.regexp_extract(name, r"^(?:.*_)?(input|label)\.json$", 1)
    flat = F.regexp_extract(name, r"^(.*)_(?:input|label)\.json$", 1)
    case = F.when(flat != "", flat).otherwise(F.substring_index(place, "/", -1))
    named = files.select(kind.alias("kind"), place.alias("dir"), flat.alias("flat"), case.alias("case_id"), "content").where("kind <> ''")
    part = lambda k, into: named.where(F.col("kind") == k).select("dir", "flat", "case_id", F.col("content").alias(into))
    pairs = part("input", "a").join(part("label", "b"), ["dir", "flat", "case_id"])
    return pairs.select("case_id", F.col("a").cast("string").alias("graph"), F.col("b").cast("string").alias("label"), F.sha2("a", 256).alias("sha256"))


def write_graph_json(pairs: DataFrame, folder: str) -> str:
    """Writes (case, input, label) as one directory a case, ``input.json`` and, where there is one, ``label.json``; gives the folder back."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                store.create_dir(f"{base}/{row['case']}", recursive=True)
                for name in ("input", "label"):
                    if row[name] is not None:
                        with store.open_output_stream(f"{base}/{row['case']}/{name}.json") as out:
                            out.write(row[name].encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    pairs.select("case", "input", "label").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder
