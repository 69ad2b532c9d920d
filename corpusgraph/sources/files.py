"""Files as rows: walks of directory trees, watches, label scans, lookups."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from corpusgraph.functions import classify as C
from corpusgraph.functions import paths as P
from corpusgraph.functions.text import content_hash, metadata_hash
from corpusgraph.operators.filters import PathConfig, changed, path_passes

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def described(raw: DataFrame, use_vision: bool | None = None) -> DataFrame:
    """(path, size, mod_time, content) rows with name, type, kind, mode and hashes."""
    found = raw.withColumn("__p", C.probe(F.col("path"), F.col("content")))
    found = found.withColumn("__d", C.decide(F.col("__p.kind"), F.col("size"), use_vision))
    nanos = (F.unix_micros(F.col("mod_time").cast("timestamp")) * 1000).cast("string")
    return found.select(
        "path", P.base(F.col("path")).alias("name"), P.extension(F.col("path")).alias("extension"), F.col("__p.mime").alias("mime_type"), F.col("__p.language").alias("language"), F.col("__p.kind").alias("ingest_kind"),
        F.col("__d.mode").alias("ingest_mode"), F.col("__d.reason").alias("ingest_reason"), "size", "mod_time", content_hash(F.col("content")).alias("content_hash"),
        metadata_hash(F.concat_ws("|", F.col("path"), F.col("size").cast("string"), nanos)).alias("metadata_hash"), "content",
    )


def plain_path(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^[a-z][a-z0-9+.-]*:(?://[^/]*)?", "")


#: Files of more bytes aren't read: they are known by their metadata only.
LARGEST_READ = 100 << 20
LISTING = "uri string, path string, size long, mod_time timestamp"
FOUND = "path string, size long, mod_time timestamp, content binary"


def listed(spark: SparkSession, root: str, config: PathConfig = PathConfig(), uri: str | None = None) -> DataFrame:
    """(uri, path, size, mod_time) of the files under root that pass, without a look into any of them;
    symlinks aren't followed by the file systems that know them. uri is where the root lies, if that
    isn't a plain path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri or root)
    own = raw.select(F.col("path").alias("uri"), plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"))
    return own.where(path_passes(F.col("path"), root, config))


def with_content(spark: SparkSession, listing: DataFrame, most: int = LARGEST_READ) -> DataFrame:
    """(path, size, mod_time, content) of a listing: only its files are opened, and of those of more
    than `most` bytes the content is null. The listing runs at once: its paths are what Spark's own
    file index holds on the driver for any scan of these files."""
    paths = [r.uri for r in listing.where(F.col("size") <= most).select("uri").toLocalIterator()]
    large = listing.where(F.col("size") > most).select("path", "size", "mod_time", F.lit(None).cast("binary").alias("content"))
    if not paths:
        return large
    # names that look like globs are taken as they are
    raw = spark.read.format("binaryFile").load([re.sub(r"([*?\[\]{}\\])", r"\\\1", p) for p in paths])
    return raw.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content").unionByName(large)


def walk(spark: SparkSession, root: str, config: PathConfig = PathConfig(), uri: str | None = None) -> DataFrame:
    """(path, size, mod_time, content) of the files under root that pass (see listed and with_content)."""
    return with_content(spark, listed(spark, root, config, uri))


def listed_all(spark: SparkSession, roots: dict[str, PathConfig]) -> DataFrame:
    """The listings of several roots; a file under two of them stands once."""
    out = spark.createDataFrame([], LISTING)
    for root, config in roots.items():
        out = out.unionByName(listed(spark, root, config))
    return out.dropDuplicates(["path"])


def walk_all(spark: SparkSession, roots: dict[str, PathConfig]) -> DataFrame:
    return with_content(spark, listed_all(spark, roots))


def walk_changed(spark: SparkSession, root: str, state: DataFrame, config: PathConfig = PathConfig(), semantic: bool = True) -> DataFrame:
    """The files of a walk that differ from the state; only these are opened."""
    return with_content(spark, changed(listed(spark, root, config), state, semantic))


def listing_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, type): what happened between two listings (path, size, mod_time): created, modified and
    deleted files, and directories that came or went with their files. Run on a schedule, it is the
    watch of file systems that tell of no changes."""
    old = before.select("path", F.col("size").alias("__s"), F.col("mod_time").alias("__m"), F.lit(True).alias("__old"))
    both = now.select("path", "size", "mod_time", F.lit(True).alias("__new")).join(old, "path", "full")
    same = F.col("size").eqNullSafe(F.col("__s")) & F.col("mod_time").eqNullSafe(F.col("__m"))
    kind = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "delete").when(~same, "modify")
    files = both.select("path", kind.alias("type")).where("type is not null")
    above = lambda df: df.select(F.explode(P.ancestors(P.directory(F.col("path")))).alias("path")).distinct()
    gone, come = above(before).join(above(now), "path", "left_anti"), above(now).join(above(before), "path", "left_anti")
    folders = come.select("path", F.lit("create directory").alias("type")).unionByName(gone.select("path", F.lit("delete directory").alias("type")))
    return files.where(~P.editor_noise(F.col("path"))).unionByName(folders)


def late_stat(events: DataFrame, listing: DataFrame) -> DataFrame:
    """events (path, type) with those of files that aren't there any more as deletes."""
    there = listing.select("path", F.lit(True).alias("__there"))
    out = events.join(there, "path", "left")
    return out.withColumn("type", F.when(F.col("__there").isNull() & ~F.col("type").contains("directory"), "delete").otherwise(F.col("type"))).drop("__there")


def watch(spark: SparkSession, root: str, config: PathConfig = PathConfig()) -> DataFrame:
    """A stream of the files that appear under root, without editors' passing files."""
    raw = spark.readStream.schema(_parse_datatype_string(BINARY_FILE)).format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = raw.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content")
    return own.where(path_passes(F.col("path"), root, config) & ~P.editor_noise(F.col("path")))


def label_scan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.select(*columns) if columns else df


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def raw_query(spark: SparkSession, sql: str, frames: dict[str, DataFrame] | None = None, **params) -> DataFrame:
    """A SQL query over named frames. Parameters are bound by name, never pasted in."""
    for name, df in (frames or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=params or None)


def root_health(path: str) -> str:
    """'ok', 'missing', 'denied' or 'error', as the driver sees a local path."""
    try:
        os.stat(path)
        os.listdir(path)
    except (FileNotFoundError, NotADirectoryError):
        return "missing" if not os.path.exists(path) else "error"
    except PermissionError:
        return "denied"
    except OSError:
        return "error"
    return "ok"


def healthy_roots(roots: list[str]) -> tuple[list[str], list[str]]:
    """(kept, dropped): only roots that are missing are dropped."""
    status = {r: root_health(r) for r in roots}
    return [r for r in roots if status[r] != "missing"], [r for r in roots if status[r] == "missing"]
