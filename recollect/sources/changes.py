"""Changes of a table of files that neither lose nor double rows.

A change is written beside the table first, in a folder that readers skip: its new files, the
list of the files they replace, then a mark. From the mark on the change is certain. Its files
move into their partitions under names that hold the name of the change, the replaced files
go, then the folder. `recover` ends a change that was cut short; every step may be repeated.

Only files that were read are removed, never a folder, so whatever other writers add at any
moment stays. Appends may run beside anything. Two changes that replace files may not overlap.
"""

from pyspark.sql import functions as F

from recollect.session import written

CHANGE, DONE = "_change-", "_done"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # names the partition of a null


def folder(spark, path):
    """(file system, path) of a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def entries(spark, path):
    """Names in a folder; none where it does not exist."""
    fs, root = folder(spark, path)
    return [e.getPath().getName() for e in fs.listStatus(root)] if fs.exists(root) else []


def size_of(spark, path):
    """Bytes of the files in a folder; none where it does not exist."""
    fs, root = folder(spark, path)
    return fs.getContentSummary(root).getLength() if fs.exists(root) else 0


def _exists(spark, path):
    fs, target = folder(spark, path)
    return fs.exists(target)


OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
WRITERS = 100         # files a task holds open; what a task has beyond them is sorted by partition first
ROW_GROUP = 8 << 20   # bytes an open file may hold in memory


def place(rows, path, parts, mode="errorifexists"):
    """Write into partitions. Rows are not dealt out by partition first, as that would shuffle all
    their texts, nor sorted by it, as that would spill them: every task holds a file open for each
    partition it meets."""
    conf = rows.sparkSession.conf
    before = conf.get(OPEN_FILES, None)
    conf.set(OPEN_FILES, str(WRITERS))
    try:
        rows.write.mode(mode).option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy(*parts).parquet(path)
    finally:
        conf.unset(OPEN_FILES) if before is None else conf.set(OPEN_FILES, before)


def stage(rows, path, name, parts, replaced=()):
    """Write a change; nothing where an earlier attempt had written it whole."""
    spark, at = rows.sparkSession, f"{path}/{CHANGE}{name}"
    if _exists(spark, f"{at}/_ready"):
        return
    fs, root = folder(spark, at)
    fs.delete(root, True)
    place(rows, f"{at}/rows", parts)
    if replaced:
        spark.createDataFrame([(f,) for f in replaced], "file string").write.parquet(f"{at}/replaced")
    fs.create(folder(spark, f"{at}/_ready")[1], True).close()


def _move(spark, path, name):
    at = f"{path}/{CHANGE}{name}"
    fs, root = folder(spark, f"{at}/rows")
    if not fs.exists(root):
        return
    top, files = fs.makeQualified(root).toString(), fs.listFiles(root, True)
    while files.hasNext():
        source = files.next().getPath()
        if source.getName().startswith(("_", ".")):
            continue
        inner = fs.makeQualified(source.getParent()).toString()[len(top):]
        _, target = folder(spark, f"{path}{inner}/{name}-{source.getName()}")
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target) and fs.exists(source):
            raise OSError(f"{source} could not be moved to {target}")


def finish(spark, path, name):
    """Put a written change into effect."""
    at = f"{path}/{CHANGE}{name}"
    _move(spark, path, name)
    if _exists(spark, f"{at}/replaced"):
        jvm = spark.sparkContext._jvm
        for r in spark.read.schema("file string").parquet(f"{at}/replaced").toLocalIterator():
            target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["file"]))
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, False)
    if "@" in name:
        _mark(spark, path, *name.rsplit("@", 1))
    fs, root = folder(spark, at)
    fs.delete(root, True)


def recover(spark, path):
    """End the changes that were written whole but not put into effect."""
    for name in entries(spark, path):
        if name.startswith(CHANGE) and _exists(spark, f"{path}/{name}/_ready"):
            finish(spark, path, name.removeprefix(CHANGE))


def _mark(spark, path, run, number):
    """Note that a numbered change is in the table; earlier notes of the run go."""
    at = f"{path}/{DONE}/{run}"
    fs, target = folder(spark, f"{at}/{number}")
    fs.create(target, True).close()
    for old in entries(spark, at):
        if old.isdigit() and int(old) < int(number):
            fs.delete(folder(spark, f"{at}/{old}")[1], False)


def is_done(spark, path, run, number):
    """Whether a numbered change, or a later one of its run, is in the table."""
    return any(n.isdigit() and int(n) >= int(number) for n in entries(spark, f"{path}/{DONE}/{run}"))


def append_once(rows, path, run, number, parts):
    """Add the rows of batch `number` of a run, whose batches come in order; a repeated batch
    changes nothing, wherever the first attempt ended. Returns whether rows were added."""
    spark, name = rows.sparkSession, f"{run}@{number}"
    if is_done(spark, path, run, number):
        return False
    stage(rows, path, name, parts)
    finish(spark, path, name)
    return True


def rewrite(spark, path, name, parts, files, kept):
    """Replace `files` by the rows that `kept` leaves of them."""
    jvm = spark.sparkContext._jvm
    names = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in files]
    stage(kept(names), path, name, parts, files)
    finish(spark, path, name)


def file_of():
    """The file a row of a table was read from."""
    return F.col("_metadata.file_path")


MARKS = 20_000  # bitmaps of 4 KB, each for 32768 rows of a file, that are handed to every task


def _place():
    return F.col("_metadata.row_index") + 1


def marks_of(table, ids):
    """(_file, _bucket, _bits): the places of a table's rows whose id is listed; only ids and places
    are shuffled."""
    rows = table.select("id", file_of().alias("_file"), _place().alias("_at")).join(ids.select("id").distinct(), "id", "left_semi")
    return written(rows.groupBy("_file", F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")), "marks")


def split(table, marks, listed):
    """The rows of a table (or of files of it) that are marked, or those that are not. Rows stay
    where they are read while there are at most MARKS bitmaps."""
    columns = table.columns
    few = marks.limit(MARKS + 1).count() <= MARKS
    at = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.get(F.array(*[byte.bitwiseAND(1 << i) != 0 for i in range(8)]), (at % 8).cast("int")), F.lit(False))
    rows = table.select("*", file_of().alias("_file"), _place().alias("_at")).withColumn("_bucket", F.bitmap_bucket_number("_at"))
    rows = rows.join(F.broadcast(marks) if few else marks, ["_file", "_bucket"], "left")
    return rows.filter(hit if listed else ~hit).select(*columns)
