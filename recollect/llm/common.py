"""Helpers the training-data operators share."""

import pyarrow as pa
from pyspark.sql import functions as F

from recollect.session import in_parts, release, written  # noqa: F401


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df, name):
    """Written under spark.checkpoint.dir and read back: cuts the lineage."""
    return written(df, name)


def discard(df):
    """Delete the folder of a table that `stored` wrote, when nothing will read it any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_of(column):
    return F.coalesce(F.col(column), F.lit(""))


def is_empty(df):
    return len(df.limit(1).collect()) == 0


def batch(schema, *columns):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Cache(dict):
    """What `make` gives for a key, in two generations of at most `entries` keys: a full
    one becomes the old one, and what is asked for again moves up."""

    def __init__(self, make, entries):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def utf8(value):
    return b"" if value is None else value.encode("utf-8")
