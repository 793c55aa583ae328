"""j3's blacklist against brute force, with windows that cross a border between batches."""

import datetime
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomwork.plans import ad_click, jobs, streams
from loomwork.streaming import operators as T

DAY, SLIDE = 1440 * 60, 360 * 60


def test_windows_cross_batches(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(k, start + datetime.timedelta(minutes=7 * k), 100 + k if k % 25 else 7, "click") for k in range(150)]  # user 7 clicks twice a batch
    rows += [(1000 + k, start + datetime.timedelta(minutes=346 + k), 8, "click") for k in range(4)]  # user 8 about a border
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    clicks = streams.clicks(spark, str(tmp_path))
    batches = defaultdict(list)
    for r in clicks.select(T.slice_of(clicks, "at", streams.SLICES).alias("slice"), F.unix_timestamp("at").alias("s"), "user_id", "ad_id", F.date_format("at", "yyyyMMddHH").alias("hour")).collect():
        batches[r["slice"]].append(r)
    order = sorted(batches)
    home = [{r["user_id"] for r in batches[f]} for f in order]
    assert any(u in home[0] and u in home[1] for u in (7, 8))

    def total(whole):
        seen, black, counts = [], set(), Counter()
        for f in order:
            seen = seen + batches[f] if whole else batches[f]
            windows = Counter((r["user_id"], w) for r in seen for w in range(r["s"] // SLIDE - 3, r["s"] // SLIDE + 1))
            black |= {u for (u, _), n in windows.items() if n > streams.LIMIT and u != 1}
            counts.update((r["hour"], r["ad_id"]) for r in batches[f] if r["user_id"] not in black)
        top = defaultdict(list)
        for (hour, ad), n in sorted(counts.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
            top[hour].append(f"{ad}:{n}")
        return {h: ",".join(x[:5]) for h, x in top.items()}

    got = {r["hour"]: r["value"] for r in jobs.j3(spark, str(tmp_path)).collect()}
    assert total(True) != total(False)
    assert got == total(True)


def test_job_without_a_database_keeps_its_tables_by_key(spark, monkeypatch, tmp_path):
    """On a cluster no database is named, and none is needed; a database that is named holds the same rows."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://elsewhere:7077")
    white, url = spark.createDataFrame([(1,)], "user_id long"), f"jdbc:derby:memory:{tmp_path.name}_ads;create=true"
    for job in (ad_click.AdClickJob(spark, white), ad_click.AdClickJob(spark, white, url)):
        for batch, part in enumerate(([("20240101", "p", "c", 1, 5), ("20240101", "p", "c", 2, 6)], [("20240101", "p", "c", 1, 7), ("20240102", "q", "c", 1, 1)])):
            for _ in range(2):
                job.put(spark.createDataFrame(part, "day string, province string, city string, ad_id long, click_count long"), "AD_STATE", ad_click.DIMS, "ad-state", batch, ad_click.STATE_TYPES)
        job.put(job.top(job.state()), "AD_TOP", ["field"], "ad-top", 0, ad_click.TOP_TYPES)
        assert sorted(map(tuple, job.state().select(*ad_click.DIMS, "click_count").collect())) == [("20240101", "p", "c", 1, 7), ("20240101", "p", "c", 2, 6), ("20240102", "q", "c", 1, 1)]
        assert sorted(map(tuple, job.tops().select("field", "value").collect())) == [("20240101:p", "1:7,2:6"), ("20240102:q", "1:1")]
