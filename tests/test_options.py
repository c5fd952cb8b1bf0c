"""Options, the chunk cache, and streams into and out of a dataset."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom import options as o
from arrayloom.errors import TypeMismatchError
from arrayloom.sources.h5 import File, FileBuilder
from arrayloom.streaming.follow import appender, follow


def test_options_are_checked():
    assert o.ChunkCache.from_h5p_cache(5, 100) == o.ChunkCache(100, 5) and o.ChunkCache.disabled().with_max_slots(2).max_slots == 2
    assert o.LibVer.from_superblock_version(3) is o.LibVer.V110 and o.LibVer.V18.label == "v18"
    assert o.Repack().drop_path("a").drop_path("b").drop == ("a", "b") and not o.MetadataCache.disabled().is_enabled
    assert o.Access().with_(locking=o.Locking.DISABLED).locking is o.Locking.DISABLED
    for bad in (lambda: o.ChunkCache(-1), lambda: o.FileSpace(page_size=100), lambda: o.Access(libver=(o.LibVer.V114, o.LibVer.V18)), lambda: o.Append("perhaps"), lambda: o.Access(page_buffer=-1), lambda: o.MetadataCache(-1)):
        with pytest.raises(TypeMismatchError):
            bad()


def test_cache_keeps_recent_chunks():
    b = FileBuilder()
    b.create_dataset("v", np.arange(100), chunks=(10,))
    data = b.finish()
    f = File(data, o.ChunkCache(max_bytes=240, max_slots=16))
    for _ in range(2):
        assert f.read("v", (0,), (30,)).tolist() == list(range(30))
    assert (f.cache_stats.hits, f.cache_stats.misses, f.cache_stats.cached) == (3, 3, 3) and f.cache_stats.hit_rate == 0.5
    f.read("v", (30,), (10,))
    assert f.cache_stats.evictions == 1 and f.cache_stats.cached_bytes == 240
    f.cache_stats.reset()
    assert f.cache_stats.lookups == 0 and f.cache_stats.hit_rate is None
    g = File(data, o.ChunkCache.disabled())
    assert g.read("v").tolist() == list(range(100)) and g.cache_stats.cached == 0 and g.cache_stats.oversize == 10


@pytest.fixture
def path(tmp_path):
    b = FileBuilder()
    b.create_dataset("v", np.zeros(0), chunks=(8,), maximum=(None,))
    b.write(str(tmp_path / "s.h5"))
    return str(tmp_path / "s.h5")


def test_stream_in_and_out(spark, path, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(20).select("id", (F.col("id") * 1.5).alias("value"))
    rows.filter("id < 12").coalesce(1).write.parquet(source)
    query = lambda: spark.readStream.schema("id long, value double").parquet(source).writeStream.foreachBatch(appender(path, "v", "id")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query().awaitTermination()
    assert File(path).read("v").tolist() == [i * 1.5 for i in range(12)]
    out = follow(spark, path, "v").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c2"))
    first = out.start()
    first.processAllAvailable()
    first.stop()
    rows.filter("id >= 12").coalesce(1).write.mode("append").parquet(source)
    query().awaitTermination()
    second = out.start()  # goes on where the first stopped
    second.processAllAvailable()
    second.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("i0").collect()
    assert [(r["i0"], r["value"]) for r in got] == [(i, i * 1.5) for i in range(20)]


def test_a_repeated_batch_is_skipped(spark, path):
    write = appender(path, "v", "id")
    batch = spark.range(3).select("id", F.col("id").cast("double").alias("value"))
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert File(path).read("v").tolist() == [0, 1, 2, 0, 1, 2]
    with pytest.raises(TypeMismatchError):
        write(spark.range(2).select("id", F.col("id").alias("value")), 2)
