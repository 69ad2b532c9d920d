"""The streaming coalescer emits what the batch fold does."""

from pyspark.sql import functions as F

from corpusgraph.plans import views as V
from corpusgraph.streaming.coalesce import coalesce_batch, coalesce_stream, notify, use_rocksdb

HOUR = 3_600_000


def test_stream_agrees_with_batch(spark, sf, tmp_path):
    use_rocksdb(spark)
    batch = coalesce_batch(V.changes(spark, sf), 2 * HOUR * 1000, 8 * HOUR * 1000)
    want = {(r.path, r.type, r.due // 1000) for r in batch.collect()}
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = F.create_map(*[F.lit(x) for p in {"signup": "create", "click": "modify", "view": "modify", "purchase": "delete"}.items() for x in p])[F.col("event_type")]
    events = raw.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), "event_id")
    seen = []
    q = notify(coalesce_stream(events, 2 * HOUR, 8 * HOUR, "1 hour", id_col="event_id"), [lambda df, n: seen.extend(df.collect())], str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r.path, r.type, int(r.due.timestamp() * 1000)) for r in seen}
    # what is still to come is pending beyond the watermark: at most one event of a path
    end = V.changes(spark, sf).where("type is not null").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("m")).first().m - HOUR
    pending = want - got
    assert got <= want and all(due > end for _, _, due in pending) and len({p for p, _, _ in pending}) == len(pending)
