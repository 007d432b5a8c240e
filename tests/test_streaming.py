from pyspark.sql import functions as F

from panelspark.operators import regression
from panelspark.sources import files
from panelspark.streaming import online


def test_online_equals_batch(spark, sf, tmp_path):
    path = f"file://{tmp_path}/in"
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_extendedprice", "l_quantity")
    li.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1).parquet(path)
    model = online.OnlineOLS("l_extendedprice", ["l_quantity"])
    model.start(stream, f"file://{tmp_path}/state").awaitTermination()
    want = regression.ols(li, "l_extendedprice", ["l_quantity"])
    assert model.last == 2 and abs(model.fit().coef[1] - want.coef[1]) < 1e-6
    before = model.n
    model.add(li, 2)
    assert model.n == before


def test_online_state_survives_a_restart(spark, sf, tmp_path):
    path, state = f"file://{tmp_path}/in", f"file://{tmp_path}/model"
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_extendedprice") + 1e9).alias("y"), (F.col("l_quantity") + 1e7).alias("x"))
    parts = [p.cache() for p in li.randomSplit([1.0] * 4, seed=1)]
    new = lambda: online.OnlineOLS("y", ["x"], path=state)

    def start(model):
        stream = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1).parquet(path)
        model.start(stream, f"file://{tmp_path}/check").awaitTermination()
        return model

    for p in parts[:2]:
        p.coalesce(1).write.mode("append").parquet(path)
    first = start(new())
    assert first.last == 1 and first.n == parts[0].count() + parts[1].count()
    # A process that dies within a batch: the state is committed, the stream's own log does not say so.
    dead = new()
    dead.add(parts[2], 2)
    again = new()
    again.add(parts[2], 2)  # comes again after the restart
    assert again.n == dead.n and again.last == 2
    # One that dies before its commit leaves nothing.
    lost = new()
    lost._commit = lambda spark: (_ for _ in ()).throw(RuntimeError("killed"))
    try:
        lost.add(parts[3], 3)
    except RuntimeError:
        pass
    for p in parts[2:]:
        p.coalesce(1).write.mode("append").parquet(path)
    last = start(new())
    want = regression.ols(spark.read.parquet(path), "y", ["x"])
    got = last.fit()
    assert last.last == 3 and last.n == want.n and abs(got.coef[1] - want.coef[1]) < 1e-6
    assert abs(got.se[1] / want.se[1] - 1) < 1e-6 and abs(got.coef[0] / want.coef[0] - 1) < 1e-9
    assert len(files.names(spark, state)) == 4
    try:
        online.OnlineOLS("y", ["z"], path=state).add(parts[0], 9)
        raise AssertionError("another model's state")
    except ValueError:
        pass


def test_windows_on_a_stream(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"file://{tmp_path}/ev"
    ev.write.parquet(path)
    stream = spark.readStream.schema(ev.schema).parquet(path)
    q = online.windowed_counts(stream, "ts", ["event_type"], "1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == ev.count()
    assert online.sessions(ev, "ts", ["user_id"], "30 minutes").agg(F.sum("n")).first()[0] == ev.count()


def test_poll_stops_when_empty(spark):
    left = [3]

    def take(n):
        return spark.range(min(n, left[0]))

    def work(batch):
        left[0] -= batch.count()

    assert online.poll(take, work, 2) == 2 and left[0] == 0
