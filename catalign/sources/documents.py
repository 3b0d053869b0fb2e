"""Manifests, mappings and report documents in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_manifest(spark: SparkSession, paths: list[str], schema: T.StructType | str, assets: str = "assets",
                  lines: bool = False) -> DataFrame:
    """Assets of the first manifest that exists; corrupt documents count as absent.

    ``schema`` is that of one asset. With ``lines`` every line is an asset, the
    form for catalogues too large for one document.
    """
    item = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = next((p for p in paths if path_exists(spark, p)), None)
    if found is None:
        return spark.createDataFrame([], item)
    bad = T.StructField("_bad", T.StringType())
    if lines:
        df = spark.read.schema(T.StructType([*item.fields, bad])).json(
            found, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
        return df.filter(F.col("_bad").isNull()).drop("_bad")
    doc = T.StructType([T.StructField(assets, T.ArrayType(item)), bad])
    df = spark.read.schema(doc).json(found, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return df.filter(F.col("_bad").isNull()).select(F.inline(assets))


def read_mapping(df: DataFrame, json_col: str, root: str | None = "textures") -> DataFrame:
    """(hash, name) rows of mapping objects; a value is a name or a list of names.

    Keys that are not hex and values that are no strings are left out.
    """
    from ..functions.hashes import normalize_hash

    if root:
        doc = F.from_json(json_col, f"`{root}` map<string, variant>")[root]
    else:
        doc = F.from_json(json_col, "map<string, variant>")
    entries = df.select(F.explode(doc).alias("key", "value"))

    def as_text(v):
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    items = F.try_variant_get("value", "$", "array<variant>")
    names = F.coalesce(F.transform(items, as_text), F.array(as_text(F.col("value"))))
    return entries.select(normalize_hash("key").alias("hash"), F.explode(names).alias("name")).filter(
        F.col("hash").isNotNull() & F.col("name").isNotNull())


def load_reports(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """One row per named summary document; missing or corrupt ones have null fields."""
    fields = T.StructType.fromDDL(schema)
    out = spark.createDataFrame([(n,) for n in paths], "report string")
    loaded = None
    for name, path in paths.items():
        if not path_exists(spark, path):
            continue
        doc = spark.read.schema(T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])).json(
            path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
        doc = doc.filter(F.col("_bad").isNull()).drop("_bad").withColumn("report", F.lit(name))
        loaded = doc if loaded is None else loaded.unionByName(doc)
    if loaded is None:
        loaded = spark.createDataFrame([], T.StructType([*fields.fields, T.StructField("report", T.StringType())]))
    return out.join(loaded, "report", "left")
