"""The beacon job against beacons taken one by one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import trending
from quarry.streaming import beacons

SCHEMA = "event_id long, at long, q string, origin string, site string, address string, agent string, opt_out boolean"
T0 = 20_600 * beacons.DAY
SITES = ["a.example", "www.b.example"]


def write(spark, folder, batches):
    os.makedirs(f"{folder}/in", exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/.b{i}")
        name = next(f for f in os.listdir(f"{folder}/.b{i}") if f.endswith(".parquet"))
        os.replace(f"{folder}/.b{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_000_000 + i, 1_000_000 + i))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def by_rule(batches):
    """One by one in order of time within each batch: counts by hour, site and query; people by day and query."""
    counts, people, windows, now = {}, {}, {}, 0
    for rows in batches:
        now = max([now, *(r[1] for r in rows)])
        for _, at, q, origin, site, address, agent, out in sorted(rows, key=lambda r: (r[1], r[0])):
            shown = " ".join((q or "").split()).strip(" !.,")
            where = next((h for h in ((origin or "").split("://")[-1].split("/")[0].lower().removeprefix("www."), (site or "").lower().removeprefix("www.")) if h in ("a.example", "b.example")), None)
            day = at // beacons.DAY
            if out or not 2 <= len(shown) <= 80 or "@" in shown or "badword" in shown.lower() or not where or day < now // beacons.DAY - 1:
                continue
            who = (day, address, agent)
            until, n = windows.get(who, (0, 0))
            until, n = (at + 60_000, 1) if at >= until else (until, n + 1)
            windows[who] = until, n
            if n <= 20:
                key = (at // beacons.HOUR, where, shown.lower())
                c, s = counts.get(key, (0, ""))
                counts[key] = c + 1, max(s, shown)
                people.setdefault((day, shown.lower()), set()).add(who)
    return {k: v for k, v in counts.items() if k[0] >= now // beacons.HOUR - 192}, {k: len(v) for k, v in people.items() if k[0] >= now // beacons.DAY - 2}


def made(seed=1, batches=4, n=150):
    rng, out, event = random.Random(seed), [], 0
    for b in range(batches):
        rows = []
        for _ in range(n):
            event += 1
            at = T0 + b * 20 * beacons.HOUR + rng.randrange(beacons.HOUR) // rng.choice([1, 60])
            rows.append((event, at, rng.choice(["red fox", " Red  Fox! ", "blue", "me@x.example", "badword here", "x", None]), rng.choice([None, "https://www.a.example/p", "https://evil.example"]), rng.choice(["b.example", "B.example", "else.example", None]), rng.choice(["1", "2"]), "ua", rng.random() < 0.1))
        rows += [(event * 1000 + b, T0 - 3 * beacons.DAY, "red fox", None, "a.example", "1", "ua", False)]  # days too late
        out.append(rows)
    return out


def check(store, batches):
    counts, people = by_rule(batches)
    assert {(r.hour, r.site, r["query"]): (r.n, r.shown) for r in store.trends().collect()} == counts
    assert {(r.day, r["query"]): r.people for r in store.visitors().groupBy("day", "query").agg(F.count("*").alias("people")).collect()} == people


@pytest.mark.parametrize("compact_every", [2, 20])
def test_counts(spark, tmp_path, compact_every):
    batches = made()
    write(spark, tmp_path, batches)
    store = beacons.start(stream(spark, tmp_path), f"{tmp_path}/job", SITES, ("badword",), compact_every)
    check(store, batches)
    kept = sorted(d for d in os.listdir(f"{tmp_path}/job/trends"))
    assert kept == (["base=3"] if compact_every == 2 else [f"batch={i}" for i in range(4)])
    assert not os.listdir(f"{tmp_path}/job/seen")  # no beacon, address or agent is left
    hours = store.trends()
    want = trending.rising_counts(hours, store.visitors(), store.clock() // beacons.HOUR, "b.example", 1).collect()
    assert store.rising("b.example", 10, 1).collect() == want and len(want) > 0


def test_salts_go(spark, tmp_path):
    """A day's salt is deleted when its time is over, and never made again; no visitor is the same on two days."""
    day = lambda d, e: [(e + i, T0 + d * beacons.DAY + i, "red fox", None, "a.example", "1", "ua", False) for i in range(3)]
    batches = [day(0, 0), day(1, 10), day(3, 20), day(0, 30)]
    write(spark, tmp_path, batches)
    store = beacons.start(stream(spark, tmp_path), f"{tmp_path}/job", SITES, (), 1)
    assert sorted(os.listdir(f"{tmp_path}/job/salts")) == [f"day={20_603}"]
    check(store, batches)
    assert store.visitors().select("visitor").distinct().count() == store.visitors().count() == 2  # days 1 and 3; day 0's have had their time


def test_lost_and_run_again(spark, tmp_path, monkeypatch):
    batches = made(7, 3, 60)
    write(spark, tmp_path, batches)
    true, armed = beacons.complete, {"n": 0}

    def fail(self, n):
        armed["n"] += 1
        if armed["n"] == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(beacons.Store, "compact", fail)
    with pytest.raises(Exception, match="lost"):
        beacons.start(stream(spark, tmp_path), f"{tmp_path}/job", SITES, ("badword",), 2)
    check(beacons.start(stream(spark, tmp_path), f"{tmp_path}/job", SITES, ("badword",), 2), batches)
    assert beacons.complete is true


def test_site_of(spark):
    rows = [("https://www.A.example:8080/x", None, "a.example"), ("https://evil.example", "b.example", "b.example"), (None, "WWW.b.example", "b.example"), ("null", "x", None), (None, None, None)]
    df = spark.createDataFrame(rows, "o string, s string, want string")
    assert all(r.got == r.want for r in df.select("want", trending.site_of(F.col("o"), F.col("s"), SITES).alias("got")).collect())
