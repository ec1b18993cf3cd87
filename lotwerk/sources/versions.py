"""Tables kept in versions: a small pointer file says which holds, and is replaced in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a bucketed table; a change rewrites the parts it touches.
BUCKETS = 64


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, from whatever file system the path names; None if there is no such file."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside path and rename it over path, so that a reader sees the old text or the new one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, target = _path(spark, path)
    _, staged = _path(spark, f"{path}_{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    target = target.makeQualified(fs.getUri(), fs.getWorkingDirectory())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    context.rename(staged.makeQualified(fs.getUri(), fs.getWorkingDirectory()), target, options)


def _pointer(spark: SparkSession, base: str) -> dict | None:
    text = read_text(spark, f"{base}/CURRENT")
    return json.loads(text) if text else None


def _switch(spark: SparkSession, base: str, paths: dict[str, str], schema: T.StructType, old: dict | None) -> None:
    """Point at paths, and delete what neither they nor the version before use: a reader of that one may still be at work."""
    before = sorted(set((old or {}).get("paths", {}).values()))
    write_text(spark, f"{base}/CURRENT", json.dumps({"paths": paths, "schema": schema.jsonValue(), "before": before}))
    whole = lambda found: {p.partition("/__bucket=")[0] for p in found}
    used, gone = {*before, *paths.values()}, set((old or {}).get("before", []))
    for path in (gone - used) | (whole(gone) - whole(used)):
        fs, p = _path(spark, path)
        fs.delete(p, True)


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def publish(df: DataFrame, base: str, key: str | None = None, buckets: int = BUCKETS) -> None:
    """Write df as the version of the table at base that holds; with key, in buckets that can be replaced one by one.

    A job that dies before the pointer is replaced leaves the old version in place.
    """
    spark = df.sparkSession
    path = f"{base}/v_{uuid.uuid4().hex}"
    if key is None:
        df.write.parquet(path)
        paths = {"": path}
    else:
        df.withColumn("__bucket", bucket_of(key, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
        paths = {str(b): f"{path}/__bucket={b}" for b in _written(spark, path)}
    _switch(spark, base, paths, df.schema, _pointer(spark, base))


def _written(spark: SparkSession, path: str) -> list[int]:
    fs, p = _path(spark, path)
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(int(n.removeprefix("__bucket=")) for n in names if n.startswith("__bucket="))


def published(spark: SparkSession, base: str, only: set[int] | None = None) -> DataFrame | None:
    """The table at base as it holds now, or only its buckets only; None if nothing was ever published there."""
    pointer = _pointer(spark, base)
    if pointer is None:
        return None
    schema = T.StructType.fromJson(pointer["schema"])
    paths = [p for b, p in pointer["paths"].items() if only is None or (b != "" and int(b) in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace_keys(rows: DataFrame, touched: DataFrame, base: str, key: str, buckets: int = BUCKETS) -> None:
    """Put rows in place of all rows of the keys touched(key) in the table at base, in one step.

    Only the buckets of touched keys are read and written anew; of the others the new version points at the files there
    are. The list of touched buckets that the driver reads has buckets entries at most.
    """
    spark = rows.sparkSession
    hit = {r[0] for r in touched.select(bucket_of(key, buckets)).distinct().collect()}
    old = _pointer(spark, base)
    kept = published(spark, base, hit)
    new = rows if kept is None else kept.join(touched.select(key).distinct(), key, "left_anti").select(*rows.columns).unionByName(rows)
    path = f"{base}/v_{uuid.uuid4().hex}"
    new.withColumn("__bucket", bucket_of(key, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
    paths = {b: p for b, p in (old or {}).get("paths", {}).items() if int(b) not in hit}
    paths |= {str(b): f"{path}/__bucket={b}" for b in _written(spark, path)}
    _switch(spark, base, paths, rows.schema, old)
