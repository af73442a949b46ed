from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.dataset import POS, Dataset, write
from quern.errors import SchemaError
from quern.plans.pruning import keep_mask
from quern.storage import scratch
from quern.streaming import stream_into


def test_append(spark):
    path = scratch(spark, "append")
    d = write(spark.range(25).select(F.col("id").alias("x")).coalesce(1), path, stripe_rows=10)
    d = d.append(spark.range(25, 40).select(F.col("id").alias("x")).coalesce(1))
    assert d.stripe_row_counts() == [10, 10, 5, 10, 5] == Dataset.open(spark, path).stripe_row_counts()
    assert all(r.x == r[POS] for r in d.frame(positions=True).collect()) and d.verify() == {"columns": 1, "rows": 40, "stripes": 5}
    assert keep_mask(d, "x = 30") == [False, False, False, True, False]
    assert [r.x for r in d.rows(18, 10).collect()] == list(range(18, 28))
    assert d.append(spark.range(0).toDF("x")).n_rows == 40
    with pytest.raises(SchemaError):
        d.append(spark.range(3).toDF("y"))


def test_append_that_breaks_off(spark, monkeypatch):
    """Wherever an append stops, rows, SQL and metadata are those of the head, and the next append replaces what it left."""
    from quern import dataset as D
    from quern.session import Session
    from quern.storage import Files

    class Stop(Exception):
        pass

    path = scratch(spark, "broken")
    write(spark.range(10).select(F.col("id").alias("x")).coalesce(1), path, stripe_rows=4)
    more = spark.range(100, 115).select(F.col("id").alias("x")).coalesce(1)

    def stop(*_, **__):
        raise Stop

    move = Files.move

    def second_move(self, a, b):
        if b.endswith("=4"):
            raise Stop
        move(self, a, b)

    for target, name, by in ((Files, "move", stop), (Files, "move", second_move), (D, "_statistics", stop), (D, "_finish", stop)):
        with monkeypatch.context() as m:
            m.setattr(target, name, by)
            with pytest.raises(Stop):
                Dataset.open(spark, path).append(more)
        d = Dataset.open(spark, path)
        s = Session(spark)
        s.register("t", path)
        assert d.n_rows == d.frame().count() == s.sql("SELECT x FROM t").count() == 10
        assert s.sql("SELECT max(x) AS hi, count(*) AS n FROM t").first() == (9, 10) and s.last == {"*": "metadata"}
        assert s.sql("SELECT x FROM t WHERE x > 7").count() == 2 and s.last == {"t": [2]}
        assert d.verify()["rows"] == 10 and d.stripe_row_counts() == [4, 4, 2]
    d = Dataset.open(spark, path).append(more.where("x < 105"))
    d = d.append(more.where("x >= 105"))
    assert d.stripe_row_counts() == [4, 4, 2, 4, 1, 4, 4, 2] and d.verify()["rows"] == 25
    assert sorted(r.x for r in Dataset.open(spark, path).frame().collect()) == [*range(10), *range(100, 115)]
    assert keep_mask(d, "x = 104") == [False] * 4 + [True] + [False] * 3


def test_head_is_never_missing(spark):
    from quern.storage import Files

    files, path = Files(spark), f"{scratch(spark, 'head')}/x.json"
    for k in range(3):
        files.write(path, str(k).encode())
        assert files.read(path) == str(k).encode() and files.names(path.rsplit("/", 1)[0]) == ["x.json"]


def test_scans_that_need_no_files(spark):
    from quern.plans.pruning import scan
    from quern.storage import Files

    path = scratch(spark, "nofiles")
    d = write(spark.range(30).selectExpr("id AS x", "id % 3 AS y").coalesce(1), path, stripe_rows=10)
    assert scan(d, limit=12).count() == 12 and scan(d, limit=10, columns=["x"]).inputFiles()[0].count("stripe_id=0") == 1
    assert sorted(r.x for r in scan(d, ["x"], limit=10).collect()) == list(range(10))
    for k in range(3):
        Files(spark).delete(f"{path}/data/stripe_id={k}")
    assert scan(d, []).count() == 30 and scan(d, [], limit=7).count() == 7
    assert scan(d, ["x"], "x > 1000").collect() == [] and scan(d, None, "x > 1000").columns == ["x", "y"]


def test_a_stream_becomes_stripes_once(spark, sf):
    source, path, check = scratch(spark, "source"), scratch(spark, "streamed"), scratch(spark, "check")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.where("event_id % 2 = 0").write.parquet(source)
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_into(stream(), path, check, stripe_rows=100).awaitTermination(120)
    events.where("event_id % 2 = 1").write.mode("append").parquet(source)
    stream_into(stream(), path, check, stripe_rows=100).awaitTermination(120)
    d = Dataset.open(spark, path)
    assert d.verify()["rows"] == events.count() and d.frame().exceptAll(events).count() == 0
    before = d.n_rows
    last = d.options["mark"]
    again = Dataset.open(spark, path)
    assert again.options["mark"] == last and before == again.n_rows
    stream_into(stream(), path, scratch(spark, "other-check"), stripe_rows=100).awaitTermination(120)
    assert Dataset.open(spark, path).n_rows == before  # batches it holds are not taken again
