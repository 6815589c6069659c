"""Late rows against a plain version of the layout; what is read, written and left alone."""

import datetime as dt
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import late_overwrite as L
from lodestone.sources import partitions

DAY = 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1)


def us(x):
    return None if x is None else (x - EPOCH) // dt.timedelta(microseconds=1)


def least(x):
    return (-(1 << 62)) if x is None else x


def day(r):
    return -1 if r["sold_at"] is None else r["sold_at"] // DAY


def keep(rows):
    best = {}
    for r in rows:
        order = lambda r: (least(r["arrived_at"]), least(r["sold_at"]))
        if r["sale_id"] not in best or order(r) > order(best[r["sale_id"]]):
            best[r["sale_id"]] = r
    return best


def layout(best, size):
    files, days = {}, {}
    for r in best.values():
        days.setdefault(day(r), []).append(r)
    for d, rows in days.items():
        rows.sort(key=lambda r: (least(r["sold_at"]), least(r["sale_id"])))
        for i in range(0, len(rows), size):
            files[d, i // size] = [r["sale_id"] for r in rows[i : i + size]]
    return files


def touched(early, late):
    start, end, own = keep(early), keep(early + late), {id(r) for r in late}
    days = set()
    for k, r in end.items():
        if id(r) in own:
            days |= {day(r)} | ({day(start[k])} if k in start else set())
    return days


def ids(spark, table):
    return {(r.day, r.file_no): r.ids_sha256 for r in L.files(spark, table).collect()}


def digests(files):
    return {k: hashlib.sha256(",".join("" if i is None else str(i) for i in v).encode()).hexdigest() for k, v in files.items()}


def test_query(spark, small):
    rows = [{**r.asDict(), "sold_at": us(r.sold_at), "arrived_at": us(r.arrived_at)} for r in spark.read.parquet(f"{small}/sales.parquet").collect()]
    size = 1 + len(rows) // 1100
    for r in list(rows):
        h = zlib.crc32(str(r["sale_id"]).encode())
        if h % 3 == 0 and day(r) % 4 == 0:
            rows.append({**r, "total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + h % 2 * DAY, "arrived_at": r["arrived_at"] + (1 + h % 97) * DAY})
    cut = us(dt.datetime(2024, 3, 20))
    early = [r for r in rows if r["arrived_at"] is not None and r["arrived_at"] < cut]
    late = [r for r in rows if r["arrived_at"] is None or r["arrived_at"] >= cut]
    best, days = keep(rows), touched(early, late)
    files = layout(best, size)
    got = {(r.day, r.file_no): r for r in L.op13_late_overwrite(spark, small).collect()}
    assert got.keys() == files.keys() and 0 < len(days) < len({d for d, _ in files})
    text = lambda x: "" if x is None else str(x)
    for k, r in got.items():
        inside = [best[i] for i in files[k]]
        assert r.n_rows == len(inside) and r.columns == "sale_id,client_id,status,total,sold_at,arrived_at,priority" and r.rewritten == (k[0] in days)
        assert r.cents == sum(0 if x["total"] is None else math.floor(100 * x["total"] + 0.5) for x in inside)
        assert r.rows_crc == sum(zlib.crc32(f"{x['sale_id']}:{text(x['sold_at'])}:{text(x['arrived_at'])}".encode()) for x in inside)
        assert r.ids_sha256 == digests(files)[k]
    assert len({r.path for r in got.values()}) == len(got)


KIND = "sale_id long, day string, file_no long, sold_at timestamp_ntz, arrived_at timestamp_ntz"


def drawn(rng, n, since, until):
    at = lambda a, b: None if rng.random() < 0.05 else EPOCH + dt.timedelta(days=rng.randint(a, b), seconds=rng.randint(0, 86399))
    return [(rng.choice([None, *range(200)]), rng.choice("xy"), rng.randint(0, 3), at(0, 9), at(since, until)) for _ in range(n)]


@pytest.mark.parametrize("words", [1, 18])
def test_awkward_tables_and_batches_in_a_row(spark, tmp_path, words):
    """Repeated keys, nulls anywhere, columns named as the folders; a filter of two words lets nearly all through and changes nothing."""
    rng = random.Random(words)
    first = drawn(rng, 150, 0, 3)
    df = lambda rows: spark.createDataFrame(rows, KIND).repartition(3)
    table = L.Layout(str(tmp_path / "t"), df(first).schema, 7)
    assert table.day == "_day" and table.file == "_file_no"
    plain = lambda rows: [{"sale_id": r[0], "sold_at": us(r[3]), "arrived_at": us(r[4])} for r in rows]
    L.write(df(first), table)
    rows = plain(first)
    assert ids(spark, table) == digests(layout(keep(rows), 7))
    for since in (4, 20):
        batch = drawn(rng, 40, since, since + 9)
        batch = [r for r in batch if r[4] is not None]
        before = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in tmp_path.rglob("*.parquet")}
        days = {r[0] for r in L.overwrite(df(batch), table, words).collect()}
        late = plain(batch)
        assert days == touched(rows, late)
        after = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in tmp_path.rglob("*.parquet")}
        same = {p for p in before if int(p.parts[-3].split("=")[1]) not in days}
        assert all(after[p] == before[p] for p in same) and not ((before.keys() - same) & after.keys())
        rows = list(keep(rows + late).values())
        assert ids(spark, table) == digests(layout(keep(rows), 7))
    assert not (tmp_path / "t" / partitions.STAGED).exists()


def test_nothing_early_nothing_late(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", 0, EPOCH, EPOCH)], KIND)
    table = L.Layout(str(tmp_path / "a"), rows.schema, 3)
    L.write(rows.limit(0), table)
    assert L.files(spark, table).count() == 0
    assert L.overwrite(rows.limit(0), table).count() == 0 and L.overwrite(rows, table).count() == 1
    assert ids(spark, table) == digests({(0, 0): [1]})
    moved = spark.createDataFrame([(1, "x", 0, EPOCH + dt.timedelta(days=2), EPOCH + dt.timedelta(days=3))], KIND)
    assert {r[0] for r in L.overwrite(moved, table).collect()} == {0, 2}  # the day it left has no files any more
    assert ids(spark, table) == digests({(2, 0): [1]}) and [p.name for p in (tmp_path / "a").iterdir() if "=" in p.name] == ["_day=2"]


def test_a_lost_switch_is_finished(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    first, batch = drawn(rng, 90, 0, 3), [r for r in drawn(rng, 30, 5, 9) if r[4] is not None]
    df = lambda rows: spark.createDataFrame(rows, KIND)
    table = L.Layout(str(tmp_path / "t"), df(first).schema, 5)
    L.write(df(first), table)
    plain = lambda rows: [{"sale_id": r[0], "sold_at": us(r[3]), "arrived_at": us(r[4])} for r in rows]
    move, moved = partitions.Folder.move, []

    def breaks(self, old, new):
        if old.startswith(partitions.STAGED) and "=" in new:
            moved.append(new)
            if len(moved) == 3:
                raise RuntimeError("lost")
        move(self, old, new)

    with monkeypatch.context() as m:
        m.setattr(partitions.Folder, "move", breaks)
        with pytest.raises(RuntimeError):
            L.overwrite(df(batch), table)
    assert L.overwrite(df([]), table).count() == 0  # which finishes what was begun
    assert ids(spark, table) == digests(layout(keep(plain(first) + plain(batch)), 5))


def test_the_filter_lets_all_members_through(spark):
    keys = spark.range(0, 20000, 7).select(F.col("id").alias("k"))
    bits = L.bloom(keys, "k", 10)
    assert bits.count() <= 1024
    through = L.may_be_in(spark.range(40000).toDF("k"), "k", bits, 10)
    assert keys.join(through, "k", "left_anti").count() == 0 and through.columns == ["k"] and through.count() < 20000


def test_times_without_a_zone_are_utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    at = dt.datetime(2024, 3, 10, 2, 30, 0, 123456)
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # has no such time on that day
        df = spark.createDataFrame([(at,), (None,), (dt.datetime(1969, 12, 31, 23, 59, 59, 999999),)], "t timestamp_ntz")
        assert [r[0] for r in df.select(L.epoch_us(df, "t")).collect()] == [us(at), None, -1]
        assert [r[0] for r in df.select(L.day_of(df, "t")).collect()] == [us(at) // DAY, -1, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
