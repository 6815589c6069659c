"""Keyed tables: what is read and written, and what a lost job leaves behind."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import keyed, partitions
from lodestone.sources.keyed import KeyedTable


def scanned(df):
    """Files and rows that the scan of a collected DataFrame read."""
    df._jdf.queryExecution().executedPlan()
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaf = plan.collectLeaves().head()
    metric = lambda name: leaf.metrics().apply(name).value()
    return len(rows), metric("numFiles"), metric("numOutputRows")


def listing(root):
    return {str(p.relative_to(root)): (p.stat().st_mtime_ns, p.stat().st_size) for p in root.rglob("*.parquet")}


@pytest.fixture
def made(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 200).alias("owner"), F.md5(F.col("id").cast("string")).alias("key"), F.col("id").alias("n"))
    made = KeyedTable.make(spark, str(tmp_path / "t"), rows.schema, "owner", "key", 8)
    assert made.append(rows) == 4000 and made.append(rows.unionByName(rows.limit(9))) == 0
    return made


def test_look_ups_read_their_buckets(spark, made, tmp_path):
    assert len({p.split("/")[0] for p in listing(tmp_path / "t")}) == 8
    n, files, read = scanned(made.of([17]))
    assert (n, files) == (20, 1) and read < 4000 / 4
    key = made.of([17]).first()["key"]
    assert made.of([17], [key]).count() == 1 and scanned(made.by_key([key]))[0] == 1
    absent = [k for k in (f"{i:032x}" for i in range(16**31, 16**31 * 15, 16**31)) if not made.rows().where(F.col("key") == k).count()][:3]
    assert all(scanned(made.by_key([k]))[2] == 0 for k in absent)  # no row group may have it
    wanted = made.rows().where("n % 7 = 0").select("owner", "key")
    assert sorted(r.n for r in made.lookup(wanted).collect()) == list(range(0, 4000, 7))
    with pytest.raises(ValueError):
        made.of(list(range(keyed.NAMED + 1)))


def test_changes_touch_only_their_buckets(spark, made, tmp_path):
    before = listing(tmp_path / "t")
    assert made.delete(spark.createDataFrame([(17,), (999,)], "owner long")) == 20
    after = listing(tmp_path / "t")
    changed = {p.split("/")[0] for p in before.keys() ^ after.keys()}
    assert len(changed) == 1 and all(before[p] == after[p] for p in before.keys() & after.keys())
    assert made.rows().count() == 3980 and made.of([17]).isEmpty()
    touched = made.upsert(spark.createDataFrame([(18, "new", -1), (18, made.of([18]).first()["key"], -2)], "owner long, key string, n long"))
    assert len(touched) == 1 and made.rows().count() == 3981 and sorted(r.n for r in made.of([18]).where("n < 0").collect()) == [-2, -1]
    assert made.upsert(spark.createDataFrame([], made.schema)) == [] and made.delete(spark.createDataFrame([], "owner long")) == 0


def test_a_job_lost_before_the_switch_changes_nothing(spark, made, monkeypatch):
    want = sorted(made.rows().collect())

    def lost(*_):
        raise RuntimeError("lost")

    for name, change in (("switch", lambda: made.delete(spark.createDataFrame([(3,)], "owner long"))), ("add", lambda: made.append(spark.createDataFrame([(3, "x", 1)], made.schema)))):
        with monkeypatch.context() as m:
            m.setattr(keyed, name, lost)
            with pytest.raises(RuntimeError):
                change()
        again = KeyedTable(spark, made.root)
        assert sorted(again.rows().collect()) == want
    assert partitions.recover(spark, made.root) == 0 and not made.folder.exists(partitions.STAGED)
    assert made.delete(spark.createDataFrame([(3,)], "owner long")) == 20


@pytest.mark.parametrize("moves", [0, 1, 2])
def test_a_switch_that_broke_off_is_finished(spark, made, monkeypatch, moves):
    want = sorted(r for r in made.rows().collect() if r.owner >= 40)
    move, done = partitions.Folder.move, []

    def breaks(self, old, new):
        if old.startswith(partitions.STAGED) and not old.endswith(".new"):
            if len(done) == moves:
                raise RuntimeError("lost")
            done.append(new)
        move(self, old, new)

    with monkeypatch.context() as m:
        m.setattr(partitions.Folder, "move", breaks)
        with pytest.raises(RuntimeError):
            made.delete(spark.range(40).select(F.col("id").alias("owner")))
    assert sorted(KeyedTable(spark, made.root).rows().collect()) == want  # opening it finishes the switch
    assert not [n for n in made.folder.names(partitions.STAGED)]


def test_additions_that_broke_off_are_finished(spark, made, monkeypatch):
    new = spark.range(300).select(F.col("id").alias("owner"), F.concat(F.lit("n"), "id").alias("key"), F.col("id").alias("n"))
    move, done = partitions.Folder.move, []

    def breaks(self, old, name):
        if old.startswith(partitions.STAGED) and not old.endswith(".new"):
            done.append(name)
            if len(done) == 4:
                raise RuntimeError("lost")
        move(self, old, name)

    with monkeypatch.context() as m:
        m.setattr(partitions.Folder, "move", breaks)
        with pytest.raises(RuntimeError):
            made.append(new)
    again = KeyedTable(spark, made.root)
    assert again.rows().count() == 4300 and again.append(new) == 0


def test_emptied_buckets_and_missing_tables(spark, made, tmp_path):
    assert made.delete(made.rows().select("owner").distinct()) == 4000
    assert made.rows().count() == 0 and not listing(tmp_path / "t") and made.of([1]).isEmpty()
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, str(tmp_path / "none"))


def test_a_bucket_has_tasks_of_its_own(spark, tmp_path, monkeypatch):
    """No task writes rows of two buckets, and a large bucket that is written anew is shared out; the rows stay the same."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart
    try:
        shared_out(spark, tmp_path, monkeypatch)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def shared_out(spark, tmp_path, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 500).cast("string").alias("owner"), F.col("id").cast("string").alias("key"))
    table = KeyedTable.make(spark, f"{tmp_path}/t", rows.schema, "owner", "key", 4)
    tasks = table._dealt(rows).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(keyed.BUCKET).alias("buckets")).collect()
    assert len(tasks) >= 4 and {r.buckets for r in tasks} == {1}
    assert table.append(rows) == 3000 and table.append(rows) == 0
    monkeypatch.setattr(keyed, "SHARE", 1)
    touched = [r[0] for r in rows.where("owner = '7'").select(table.bucket_of(F.col("owner"))).distinct().collect()]
    dealt = table._dealt(rows.where(table.bucket_of(F.col("owner")) == touched[0]), touched)
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1
    assert table.delete(spark.createDataFrame([("7",)], "owner string")) == 6
    left = sorted((r.owner, r.key) for r in table.rows().collect())
    assert left == sorted((r.owner, r.key) for r in rows.where("owner <> '7'").collect())
