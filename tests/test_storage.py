from pathlib import Path

from weftline.plans import storage as S


def test_spills_live_in_the_shared_folder_until_dropped(spark):
    base = S.shared_dir(spark)
    assert base == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    a, b = S.Spill(spark.range(5), "a"), S.Spill(spark.range(3), "b")
    assert a.path.startswith(base) and a.df.count() == 5 and b.df.count() == 3
    a.drop()
    assert not Path(a.path.removeprefix("file://")).exists()
    assert S.drop_spills() >= 1 and not Path(b.path.removeprefix("file://")).exists() and S.drop_spills() == 0


def test_record_batches_are_restored(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with S.record_batches(spark, 7):
        sizes = [r.n for r in spark.range(20).coalesce(1).mapInArrow(lambda it: (b.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()]
    assert max(sizes) == 7 and spark.conf.get(key) == before
