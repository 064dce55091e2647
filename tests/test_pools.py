from platen.operators import pools

SCHEMA = "line long, seq long, frame_id long, kind string, sharpness double, shows boolean, verdict string, whole boolean, score double"


def seen(n, verdict, score=None, whole=True, line=1):
    return (line, n, n, "seen", None, None, verdict, whole, score)


def raw(n, sharp, shows=True, line=1):
    return (line, n, n, "raw", sharp, shows, None, None, None)


def control(n, kind, line=1):
    return (line, n, n, kind, None, None, None, None, None)


GONE = [seen(n, None) for n in (90, 91, 92)]


def run(spark, rows):
    return sorted((r.line, r.session, r.frame_id, r.source) for r in pools.published(spark.createDataFrame(rows, SCHEMA)).collect())


def test_the_pool_collects_while_a_whole_defect_is_in_view(spark):
    rows = [raw(0, 99.0), seen(1, "ok"), raw(2, 98.0), seen(3, "ng", 5.0), raw(4, 7.0), raw(5, 9.0), raw(6, 8.0), seen(7, "ng", 6.0, whole=False), raw(8, 97.0), seen(9, None), raw(10, 96.0), *GONE]
    assert run(spark, rows) == [(1, 1, 5, "pool")]
    # The sharpest pool frame doesn't show it: the best inferred frame, whole ones first.
    rows = [seen(1, "ng", 9.0, whole=False), seen(2, "ng", 3.0), raw(3, 9.0, shows=False), raw(4, 1.0), *GONE]
    assert run(spark, rows) == [(1, 1, 2, "inferred")]
    # Objects without a defect publish nothing; two empty frames don't end an object.
    assert run(spark, [seen(1, "ok"), raw(2, 5.0), *GONE]) == []
    assert run(spark, [seen(1, "ng", 1.0), seen(2, None), seen(3, None), seen(4, "ng", 2.0), *GONE]) == [(1, 1, 4, "inferred")]
    assert run(spark, [seen(1, "ng", 1.0), *GONE[:2]]) == []


def test_pause_drops_the_object(spark):
    rows = [seen(1, "ng", 1.0), raw(2, 5.0), control(3, "pause"), raw(4, 6.0), seen(5, "ng", 9.0), seen(6, None), control(7, "resume"), seen(8, None), seen(9, None), seen(10, None), seen(11, "ng", 2.0), *GONE]
    assert run(spark, rows) == [(1, 2, 11, "inferred")]


def test_lines_and_missing_scores(spark):
    rows = [seen(1, "ng", None), raw(2, None), *GONE, *[seen(n, v, 1.0, line=2) for n, v in ((1, "ng"), (2, None), (3, None), (4, None), (5, "ng"), (6, None), (7, None), (8, None))]]
    assert run(spark, rows) == [(2, 1, 1, "inferred"), (2, 2, 5, "inferred")]
    assert run(spark, rows[:0]) == []


def test_streaming_twin(spark, tmp_path):
    from platen.streaming import pools as streaming

    # A query with a timer goes on without data else.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[seen(1, "ng", 1.0), raw(2, 5.0), raw(3, 6.0), seen(1, "ng", 1.0, line=2), control(2, "pause", line=2)], [*GONE, control(3, "resume", line=2), *[seen(n, None, line=2) for n in (5, 6, 7)]]]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = streaming.published(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    got = sorted((r.line, r.session, r.frame_id, r.source) for r in spark.read.parquet(out).collect())
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got == run(spark, parts[0] + parts[1]) == [(1, 1, 3, "pool")]
