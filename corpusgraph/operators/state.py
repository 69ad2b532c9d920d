"""Bookkeeping tables: file state, discovery, remembered roots, the persistence queue, reconciling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import paths as P
from corpusgraph.operators.graph import BROADCAST_ROWS, upsert


class PathNotFound(LookupError):
    pass


class PathExists(ValueError):
    pass


upsert_state = upsert_discovery = lambda old, new: upsert(old, new, ["path"])


def record_metadata(state: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Hashes, sizes and times of new (path, content_hash, metadata_hash, size, mod_time) into the state.

    A changed content hash clears the later stages.
    """
    fresh = new.select("path", *[F.col(c).alias(f"__{c}") for c in ("content_hash", "metadata_hash", "size", "mod_time")], F.lit(True).alias("__new"))
    both = state.join(fresh, "path", "full")
    is_new = F.coalesce("__new", F.lit(False))
    reset = is_new & ~F.col("content_hash").eqNullSafe(F.col("__content_hash"))
    later = {"semantic_analyzed_at", "semantic_error", "embeddings_analyzed_at", "embeddings_error"}
    retries = {"semantic_retry_count", "embeddings_retry_count"}
    cols = []
    for c in state.columns:
        if c in ("content_hash", "metadata_hash", "size", "mod_time"):
            cols.append(F.when(is_new, F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        elif c == "metadata_analyzed_at":
            cols.append(F.when(is_new, now).otherwise(F.col(c)).alias(c))
        elif c in later:
            cols.append(F.when(~reset, F.col(c)).alias(c))
        elif c in retries:
            cols.append(F.when(reset, F.lit(0)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return both.select(*cols)


def record_stage(state: DataFrame, results: DataFrame, stage: str, now: Column) -> DataFrame:
    """results (path, error) of the stage 'semantic' or 'embeddings': no error stamps the stage,
    clears its error and count; an error is kept and counted."""
    r = results.select("path", F.col("error").alias("__e"), F.lit(True).alias("__r"))
    hit, ok = F.coalesce("__r", F.lit(False)), F.col("__e").isNull()
    at, err, n = f"{stage}_analyzed_at", f"{stage}_error", f"{stage}_retry_count"
    done = {
        at: F.when(hit & ok, now).otherwise(F.col(at)),
        err: F.when(hit, F.col("__e")).otherwise(F.col(err)),
        n: F.when(hit & ok, F.lit(0)).when(hit, F.coalesce(n, F.lit(0)) + 1).otherwise(F.col(n)),
    }
    return state.join(r, "path", "left").select(*[done.get(c, F.col(c)).alias(c) for c in state.columns])


def clear_analysis(state: DataFrame, which: Column) -> DataFrame:
    out = state
    for c in ("metadata_analyzed_at", "semantic_analyzed_at", "semantic_error", "embeddings_analyzed_at", "embeddings_error"):
        out = out.withColumn(c, F.when(~which, F.col(c)))
    for c in ("semantic_retry_count", "embeddings_retry_count"):
        out = out.withColumn(c, F.when(which, F.lit(0)).otherwise(F.col(c)))
    return out


def delete_one(table: DataFrame, path: str) -> DataFrame:
    if table.where(F.col("path") == path).isEmpty():
        raise PathNotFound(path)
    return table.where(F.col("path") != path)


def delete_under(table: DataFrame, prefix: str) -> DataFrame:
    return table.where(~P.under(F.col("path"), prefix))


def counts_under(state: DataFrame, prefix: str) -> DataFrame:
    """One row of counts of files under a prefix: all, analysed and embedded ones."""
    own = state.where(P.under(F.col("path"), prefix))
    return own.agg(F.count(F.lit(1)).alias("files"), F.count("semantic_analyzed_at").alias("analyzed"), F.count("embeddings_analyzed_at").alias("embedded"))


def add_root(roots: DataFrame, path: str, config_json: str | None = None) -> DataFrame:
    p = P.clean(path)
    if not roots.where(F.col("path") == p).isEmpty():
        raise PathExists(p)
    row = roots.sparkSession.createDataFrame([(p, config_json)], "path string, config_json string")
    return roots.unionByName(row, allowMissingColumns=True)


def change_root(roots: DataFrame, path: str, **values: Column) -> DataFrame:
    p = P.clean(path)
    if roots.where(F.col("path") == p).isEmpty():
        raise PathNotFound(p)
    return roots.select(*[F.when(F.col("path") == p, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in roots.columns])


def remove_root(roots: DataFrame, path: str) -> DataFrame:
    return delete_one(roots, P.clean(path))


def deepest_root(files: DataFrame, roots: DataFrame, root_col: str = "root", exclude_root_config: bool = True) -> DataFrame:
    """files with the longest root that is their path or an ancestor of it; null if there is none.

    An equi-join on exploded ancestors, so it needs no cross product whatever the number of roots.
    Distinct directories are matched, not files: files of one directory share the answer.
    """
    at = P.directory(F.col("path"))
    dirs = files.select(at.alias("__dir")).distinct()
    up = dirs.select("__dir", F.explode(P.ancestors(F.col("__dir"))).alias("__a"))
    own = roots.select(F.col("path").alias("__a")).distinct()
    best = up.join(own, "__a").groupBy("__dir").agg(F.max_by("__a", F.char_length("__a")).alias("__best"))
    exact = own.select(F.col("__a").alias("path"), F.lit(True).alias("__exact"))
    out = files.withColumn("__dir", at).join(best, "__dir", "left").join(exact, "path", "left")
    return out.withColumn(root_col, F.when(F.col("__exact"), F.col("path")).otherwise(F.col("__best"))).drop("__dir", "__best", "__exact")


def remembered_only(files: DataFrame, roots: DataFrame) -> DataFrame:
    return deepest_root(files, roots, "__root").where("__root is not null").drop("__root")


def stale_paths(state: DataFrame, discovery: DataFrame, seen: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, in_state, in_discovery): known paths that the last walk of their root didn't see.

    A root of which the walk saw nothing at all is left alone, each root by itself.
    """
    known = state.select("path", F.lit(1).alias("s"), F.lit(0).alias("d")).unionByName(discovery.select("path", F.lit(0).alias("s"), F.lit(1).alias("d")))
    known = known.groupBy("path").agg((F.max("s") == 1).alias("in_state"), (F.max("d") == 1).alias("in_discovery"))
    placed = deepest_root(known.join(seen.select("path"), "path", "left_anti"), roots)
    alive = deepest_root(seen.select("path"), roots).where("root is not null").select("root").distinct()
    return placed.join(alive, "root", "left_semi").select("path", "root", "in_state", "in_discovery")


def with_status(roots: DataFrame, health: DataFrame) -> DataFrame:
    """roots with the status of health (path, status); a root without one is 'error'."""
    return roots.join(health.select("path", "status"), "path", "left").withColumn("status", F.coalesce("status", F.lit("error")))


# --- the persistence queue: pending -> inflight -> completed, or back to pending, or failed


def enqueue(queue: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Rows (file_path, content_hash, result_json) become pending; those known start anew."""
    fresh = new.select("file_path", "content_hash", F.col("result_json").alias("__j"), F.lit(True).alias("__new")).dropDuplicates(["file_path", "content_hash"])
    both = queue.join(fresh, ["file_path", "content_hash"], "full")
    is_new = F.coalesce("__new", F.lit(False))
    values = {
        "id": F.coalesce(F.col("id"), F.xxhash64("file_path", "content_hash")), "result_json": F.when(is_new, F.col("__j")).otherwise(F.col("result_json")),
        "status": F.when(is_new, F.lit("pending")).otherwise(F.col("status")), "retry_count": F.when(is_new, F.lit(0)).otherwise(F.col("retry_count")),
        "error_message": F.when(~is_new, F.col("error_message")), "enqueued_at": F.when(is_new, now).otherwise(F.col("enqueued_at")), "updated_at": F.when(is_new, now).otherwise(F.col("updated_at")),
    }
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in queue.columns])


def dequeue(queue: DataFrame, n: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(batch, queue): the n oldest pending rows, which are inflight afterwards."""
    batch = queue.where("status = 'pending'").orderBy("enqueued_at", "id").limit(n)
    taken = batch.select(F.col("id").alias("__id"), F.lit(True).alias("__t"))
    taken = F.broadcast(taken) if n <= BROADCAST_ROWS else taken
    rest = queue.join(taken, F.col("id") == F.col("__id"), "left").withColumn("status", F.when(F.col("__t"), "inflight").otherwise(F.col("status")))
    return batch.withColumn("status", F.lit("inflight")), rest.withColumn("updated_at", F.when(F.col("__t"), now).otherwise(F.col("updated_at"))).select(*queue.columns)


def finish(queue: DataFrame, results: DataFrame, now: Column, most_retries: int = 3) -> DataFrame:
    """results (id, error): no error completes; an error counts, and fails the row at most_retries."""
    r = results.select("id", F.col("error").alias("__e"), F.lit(True).alias("__r"))
    hit, ok, n = F.coalesce("__r", F.lit(False)), F.col("__e").isNull(), F.col("retry_count") + 1
    values = {
        "status": F.when(hit & ok, "completed").when(hit & (n >= most_retries), "failed").when(hit, "pending").otherwise(F.col("status")),
        "retry_count": F.when(hit & ~ok, n).otherwise(F.col("retry_count")), "error_message": F.when(hit, F.col("__e")).otherwise(F.col("error_message")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    return queue.join(r, "id", "left").select(*[values.get(c, F.col(c)).alias(c) for c in queue.columns])


def purge(queue: DataFrame, now: Column, completed: str = "1 hour", failed: str = "7 days") -> DataFrame:
    old = lambda age: F.col("updated_at") < now - F.expr(f"interval {age}")
    return queue.where(~F.coalesce((F.col("status") == "completed") & old(completed) | (F.col("status") == "failed") & old(failed), F.lit(False)))


def queue_stats(queue: DataFrame) -> DataFrame:
    """One row: rows by status and the oldest pending time."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return queue.agg(*[n(s) for s in ("pending", "inflight", "completed", "failed")], F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("status") == "pending", F.col("enqueued_at"))).alias("oldest_pending"))


def schema_version(migrations: DataFrame) -> DataFrame:
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def bounded_events(events: DataFrame, most: int = 1000) -> DataFrame:
    """The newest events, at most so many, in order: the critical queue, which drops its oldest."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(most).orderBy("created_at", "id")


#: The events that must not be lost: only these go through the critical queue.
CRITICAL = ("path_deleted", "file_discovered")


def enqueue_events(queue: DataFrame, new: DataFrame, most: int = 1000) -> DataFrame:
    """The critical ones of new events (id, event_type, payload, created_at) join the queue."""
    return bounded_events(queue.unionByName(new.where(F.col("event_type").isin(*CRITICAL)).select(*queue.columns)), most)


def dequeue_events(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(batch, queue): the n oldest events, which are out of the queue before they are delivered, so that
    each is delivered once at most. For delivery once at least, write the queue after the batch is done."""
    batch = queue.orderBy("created_at", "id").limit(n)
    return batch, acknowledge(queue, batch)


def acknowledge(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without the events that are done."""
    return queue.join(done.select("id"), "id", "left_anti").select(*queue.columns)
