"""Readers and writers of line JSON, page folders and keyed tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexweave.functions import text


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Line JSON with a schema. Strict: a line that is no object of the schema fails the read. Otherwise such lines come
    as rows of nulls with their text in ``_bad``; blank lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    s = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(s + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def json_problems(spark: SparkSession, path: str) -> DataFrame:
    """(line, problem) of lines that are no JSON object or name a key twice."""

    @F.pandas_udf("string")
    def problem(s: pd.Series) -> pd.Series:
        def pairs(items):
            keys = [k for k, _ in items]
            if len(set(keys)) < len(keys):
                raise KeyError
            return dict(items)

        def one(x):
            try:
                return None if isinstance(json.loads(x, object_pairs_hook=pairs), dict) else "NOT_AN_OBJECT"
            except KeyError:
                return "REPEATED_KEY"
            except ValueError:
                return "NOT_JSON"

        return s.map(one)

    d = spark.read.text(path).where(text.blank_to_null("value").isNotNull())
    return d.select(F.col("value").alias("line"), problem("value").alias("problem")).where("problem is not null")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array or object each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_page_folders(spark: SparkSession, root: str) -> DataFrame:
    """(law_id, layout, html_path, metadata_path) of folders that hold main.html and metadata.json; ``<id>/latest`` goes
    before ``<id>`` itself. Only paths are read, not contents."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    p = f.select("path", F.regexp_extract("path", r"/([^/]+)/(latest/)?(main\.html|metadata\.json)$", 1).alias("law_id"), (F.regexp_extract("path", r"/([^/]+)/(latest/)?(main\.html|metadata\.json)$", 2) != "").alias("latest"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file")).where("law_id <> ''")
    both = p.groupBy("law_id", "latest").agg(F.max(F.when(F.col("file") == "main.html", F.col("path"))).alias("html_path"), F.max(F.when(F.col("file") == "metadata.json", F.col("path"))).alias("metadata_path")).where("html_path is not null and metadata_path is not null")
    w = Window.partitionBy("law_id").orderBy(F.desc("latest"))
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select("law_id", F.when(F.col("latest"), "latest").otherwise("flat").alias("layout"), "html_path", "metadata_path")


def read_texts(spark: SparkSession, paths: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False, protected: Iterable[str] = ()) -> None:
    """Line JSON, written by commit: an existing folder is refused unless ``overwrite``, a path under a protected root always."""
    if any(path.rstrip("/").startswith(p.rstrip("/")) for p in protected):
        raise PermissionError(f"{path} is protected")
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def assert_no_secrets(df: DataFrame, columns: Iterable[str]) -> None:
    """Refuses a frame in which a column looks like a secret; names labels, never the text."""
    found = df.select(F.explode(F.array_distinct(F.flatten(F.array(*[text.secret_labels(F.coalesce(F.col(c), F.lit(""))) for c in columns])))).alias("label")).distinct().limit(20).collect()
    if found:
        raise ValueError("looks like secrets: " + ", ".join(sorted(r["label"] for r in found)))


def upsert_parquet(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int = 64) -> None:
    """Rows put into a keyed table of ``buckets`` folders: only folders of keys in ``rows`` are written again, by dynamic
    partition overwrite. Of repeated keys in ``rows`` one counts. Writing the same rows again changes nothing."""
    b: Column = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_bucket", b)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        new.write.partitionBy("_bucket").parquet(path)
        return
    old = spark.read.parquet(path)  # what is there and can't be read is an error, not a new table
    from lexweave.session import materialize

    touched = [r[0] for r in new.select("_bucket").distinct().collect()]
    kept = old.where(F.col("_bucket").isin(touched)).join(new.select(key), key, "left_anti")
    merged = materialize(kept.select(*new.columns).unionByName(new))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
