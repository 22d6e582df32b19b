"""Log files as a table (S3, S25, S28, D6): listed without opening one, chosen by path and time, then read once.

Listing asks a file source for paths, sizes and times only, so no content is read, however large the logs are. Patterns,
twins and time bounds are decided on that narrow table; the chosen paths are handed to one text scan, whose file index
holds the same list.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import keep_first
from ..operators.ranking import with_sum_before
from ..session import stage
from .lines import ISO_MS, LINE_SCHEMA, read_documents, read_lines

FILE_COLUMNS = ["root", "path", "rel", "size", "mtime"]
FILES = "root string, path string, rel string, size bigint, mtime string"
WALKED = "path string, is_folder boolean, size bigint, mtime_ms bigint"
LISTED = "path string, size bigint, mtime_ms bigint"
OPEN_BYTES = 1 << 12  # to open a file costs as much as to read so much of it
HOME_FILES = "home string, rank int, rel string, path string, size bigint, mtime string"


@dataclass(frozen=True)
class LogFiles:
    """Where an agent keeps its logs: folders below a home, and which paths below them are logs.

    ``kind``: "lines", "documents" (one text per file) or "binary". ``twins``: folders come in order of preference and
    one path below several of them is one log. ``otherwise``: the folder to look in when a home has none of the others.
    """

    folders: tuple[str, ...]
    pattern: str
    kind: str = "lines"
    twins: bool = False
    otherwise: str | None = None


def _qualified(spark: SparkSession, roots: Iterable[str]) -> list[str]:
    """The roots that exist, as the file system spells them."""
    hadoop, conf, found = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration(), []
    for root in roots:
        place = hadoop.Path(root)
        system = place.getFileSystem(conf)
        if system.exists(place):
            found.append(_spelled(system.makeQualified(place).toString().rstrip("/")))
    return list(dict.fromkeys(found))


def _spelled(path: str) -> str:
    return "file:///" + path[len("file:/") :].lstrip("/") if path.startswith("file:/") else path


def list_files(spark: SparkSession, roots: str | list[str], modified_after: str | None = None) -> DataFrame:
    """(root, path, rel, size, mtime) of all files below the roots; a root that is not there has none. Staged.

    ``rel`` is the path below the nearest root. A file below two of the roots is listed once; files without a byte, and
    those whose names begin with "_" or ".", are not listed, as file sources never read them.
    """
    found = _qualified(spark, [roots] if isinstance(roots, str) else roots)
    if not found:
        return spark.createDataFrame([], FILES)
    tops = [r for r in found if not any(r != o and r.startswith(o + "/") for o in found)]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    path = F.regexp_replace("path", "^file:/+", "file:///")
    nearest = sorted(found, key=len, reverse=True)
    root = F.coalesce(*[F.when(F.startswith("path", F.lit(r + "/")), F.lit(r)) for r in nearest])
    listed = reader.load([_literal(r) for r in tops]).select(
        path.alias("path"), F.col("length").alias("size"), F.date_format("modificationTime", ISO_MS).alias("mtime"))
    placed = listed.withColumn("root", root).withColumn("rel", F.substr("path", F.length("root") + 2)).select(*FILE_COLUMNS)
    # Splits hold files by size, but nothing of them is read: a few tasks per core list any amount of data.
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1t")
    try:
        return stage(placed, "files")
    finally:
        spark.conf.set(setting, before)


def _literal(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return "".join("\\" + ch if ch in "*?[]{}\\" else ch for ch in path)


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose path below the root matches."""
    return files.filter(F.col("rel").rlike(pattern))


def first_of_twins(files: DataFrame) -> DataFrame:
    """Of files with one path below a home's folders, the one in the folder of least rank."""
    return keep_first(files, ["home", "rel"], ["rank", "path"])


def home_files(spark: SparkSession, homes: str | list[str], logs: LogFiles, modified_after: str | None = None) -> DataFrame:
    """(home, rank, rel, path, size, mtime) of an agent's logs in several homes, listed at once; ``rank`` is the folder's place."""
    known: dict[str, tuple[str, int]] = {}
    for home in [homes] if isinstance(homes, str) else homes:
        places = [(_qualified(spark, [f"{home.rstrip('/')}/{f}"]), i) for i, f in enumerate(logs.folders)]
        if logs.otherwise is not None and not any(found for found, _ in places):
            places = [(_qualified(spark, [f"{home.rstrip('/')}/{logs.otherwise}"]), 0)]
        known |= {root: (home.rstrip("/"), i) for found, i in places for root in found}
    if not known:
        return spark.createDataFrame([], HOME_FILES)
    files = matching(list_files(spark, list(known), modified_after), logs.pattern)
    pick = lambda k: F.coalesce(*[F.when(F.col("root") == root, F.lit(v[k])) for root, v in known.items()])
    placed = files.select(pick(0).alias("home"), pick(1).alias("rank"), "rel", "path", "size", "mtime")
    return first_of_twins(placed) if logs.twins else placed


def read_listed(files: DataFrame, kind: str = "lines") -> DataFrame:
    """Lines, whole texts or (path, content) of exactly the listed files, in one scan."""
    spark = files.sparkSession
    paths = [_literal(r["path"]) for r in files.select("path").distinct().toLocalIterator()]
    if kind == "binary":
        content = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, content binary")
        return content.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "content")
    if not paths:
        return spark.createDataFrame([], LINE_SCHEMA)
    return read_documents(spark, paths, None) if kind == "documents" else read_lines(spark, paths, None)


def mounted(spark: SparkSession, root: str) -> str | None:
    """The name by which tasks open a folder that they mount; None on other file systems."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(place).toUri().getPath() if system.getUri().getScheme() == "file" else None


def walk_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime_ms) of all files below a mounted folder, plain names; one that is not there has none. Staged.

    Tasks list a level of folders at a time, so the driver holds none of the files, however many there are. Names are
    hidden as file sources hide them.
    """
    level, found = spark.createDataFrame([(folder,)], "path string"), spark.createDataFrame([], LISTED)
    while not level.isEmpty():
        dealt = level.repartition(spark.sparkContext.defaultParallelism)
        walked = stage(dealt.mapInArrow(_scan_folders, WALKED), "walked")
        found = found.unionByName(walked.filter("NOT is_folder").drop("is_folder"))
        level = walked.filter("is_folder").select("path")
    return found


def _scan_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for folder in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
        entries = _entries(folder)
        while some := list(itertools.islice(entries, 1 << 14)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["path", "is_folder", "size", "mtime_ms"])


def _entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    try:
        entries = os.scandir(folder)
    except FileNotFoundError:  # gone since its name was seen
        return
    with entries:
        for entry in entries:
            if not _hidden(entry.name) and (entry.is_dir() or entry.is_file()):
                try:
                    seen = entry.stat()
                except FileNotFoundError:
                    continue
                yield entry.path, entry.is_dir(), seen.st_size, seen.st_mtime_ns // 1_000_000


def _hidden(name: str) -> bool:
    """The names that Spark's file sources leave out."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def land_lists(spark: SparkSession, folder: str, glob: str | None, landed: str, bytes_per_list: int, files_per_list: int | None = None) -> None:
    """Name the files below a mounted folder that no list under ``landed`` names yet in lists of their own, oldest first.

    A list is one Parquet file. It ends with the file that reaches ``bytes_per_list``, or ``files_per_list`` if that is
    given. Lists land one after the other, whole or not at all, so a call that is cut off is made good by the next one.
    """
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = walk_files(spark, folder)
    if glob:
        files = files.filter(F.regexp_extract("path", "[^/]*$", 0).rlike(f"^(?s:{hadoop.GlobPattern(glob).compiled().pattern()})$"))
    place = hadoop.Path(landed)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(place)
    lists = [int(x.getPath().getName()) for x in system.listStatus(place)]
    if lists:
        files = files.join(read_lists(spark, landed).select("path"), "path", "left_anti")
    cost, most = (F.lit(1), files_per_list) if files_per_list else (F.col("size") + OPEN_BYTES, bytes_per_list)
    summed = with_sum_before(files, ["mtime_ms", "path"], cost.cast("bigint"), "before")
    dealt = stage(summed.withColumn("list", F.floor(F.col("before") / most)).drop("before").repartition("list"), "new-files", ("list",))
    for row in dealt.select("list").distinct().orderBy("list").collect():  # a stream takes them by the time they landed
        one = dealt.filter(F.col("list") == row["list"]).drop("list")
        one.coalesce(1).write.parquet(f"{landed}/{max(lists, default=-1) + 1 + row['list']:08d}")


def read_lists(spark: SparkSession, landed: str) -> DataFrame:
    """(path, size, mtime_ms) of all files that ``land_lists`` has named."""
    return spark.read.schema(LISTED).option("recursiveFileLookup", "true").parquet(landed)
