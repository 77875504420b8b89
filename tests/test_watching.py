"""Continuous queries: matches, watermarks, failed pushes and losses between push and advance."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.streaming import watching

SAVED = "saved_id string, subject string, words array<string>, created_at long"
CHANGE = "rid long, at long, text string, exposure int, visibility string, subjects array<string>"
QUERIES = [("s1", "u1", ["red", "fox"], 0), ("s2", "u2", ["fox"], 15), ("s3", "u3", ["blue"], 0), ("s4", "u4", ["nowhere", "fox"], 0), ("s5", "u5", [], 0)]
FIRST = [(1, 10, "a red fox", 3, "public", None), (2, 20, "Fox!", 3, "public", None), (3, 20, "red FOX secret", 1, "private", ["u1"]), (4, 20, "blue", 0, "draft", ["u3"])]
SECOND = [(5, 30, "the blue red fox", 3, "public", None), (2, 31, "Fox again", 3, "public", None), (1, 32, "now private red fox", 1, "private", ["u9"])]


def write(spark, folder, batches):
    os.makedirs(f"{folder}/in", exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.parquet(f"{folder}/.b{i}")
        name = next(f for f in os.listdir(f"{folder}/.b{i}") if f.endswith(".parquet"))
        os.replace(f"{folder}/.b{i}/{name}", f"{folder}/in/{i}.parquet")
        os.utime(f"{folder}/in/{i}.parquet", (1_000_000 + i, 1_000_000 + i))


def watch(spark, folder):
    w = watching.Watch(spark, f"{folder}/w")
    if not os.path.exists(f"{folder}/w/index"):
        w.index(spark.createDataFrame(QUERIES, SAVED), spark.createDataFrame([("fox", 9), ("red", 2)], "term string, df long"))
    return w


def stream(spark, folder):
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


class Receiver:
    """Takes notifications, each (saved_id, tick) once; refuses some, and may be lost after it took them."""

    def __init__(self, refuse=None, lose=None):
        self.got, self.calls, self.refuse, self.lose = {}, 0, refuse or {}, lose

    def __call__(self, rows):
        self.calls += 1
        bad = []
        for r in rows.collect():
            if r.saved_id in self.refuse.get(r.tick, ()):
                bad.append((r.saved_id,))
                continue
            told = (r.n, list(r.rids))
            assert self.got.setdefault((r.saved_id, r.tick), told) == told  # what is told again is the same
        if self.lose == rows.agg(F.max("tick")).first()[0]:
            self.lose = None
            raise RuntimeError("lost")
        return rows.sparkSession.createDataFrame(bad, "saved_id string")


WANT = {("s1", 0): (2, [3, 1]), ("s2", 0): (1, [2]), ("s1", 1): (1, [5]), ("s2", 1): (2, [2, 5]), ("s3", 1): (1, [5])}


def test_two_batches(spark, tmp_path):
    write(spark, str(tmp_path), [FIRST, SECOND])
    w, to = watch(spark, tmp_path), Receiver()
    w.run(stream(spark, tmp_path), to)
    assert to.got == WANT
    assert {r.saved_id: r.watermark for r in w.watermarks().collect()} == dict.fromkeys(("s1", "s2", "s3", "s4"), 32)
    assert w.notifications().count() == 5
    plan = spark.read.parquet(f"{tmp_path}/w/index").where("term = 'red'").collect()
    assert [r.saved_id for r in plan] == ["s1"]  # its rarest word


def test_refused_ones_are_told_later(spark, tmp_path):
    """A failed push keeps the watermark and the matches; of a document that changed since, what it is now counts."""
    write(spark, str(tmp_path), [FIRST, SECOND, [(9, 40, "nothing", 3, "public", None)]])
    w, to = watch(spark, tmp_path), Receiver({0: {"s1"}, 1: {"s1", "s3"}})
    w.run(stream(spark, tmp_path), to)
    assert to.got == {("s2", 0): (1, [2]), ("s2", 1): (2, [2, 5]), ("s1", 2): (2, [5, 3]), ("s3", 2): (1, [5])}
    assert {r.saved_id: r.watermark for r in w.watermarks().collect()} == dict.fromkeys(("s1", "s2", "s3", "s4"), 40)


@pytest.mark.parametrize("tick", [0, 1])
def test_lost_between_push_and_advance(spark, tmp_path, tick):
    write(spark, str(tmp_path), [FIRST, SECOND])
    to = Receiver(lose=tick)
    with pytest.raises(Exception, match="lost"):
        watch(spark, tmp_path).run(stream(spark, tmp_path), to)
    moved = {r.watermark for r in watch(spark, tmp_path).watermarks().collect()}
    assert moved == (set() if tick == 0 else {20})  # nothing has moved that was not written
    watch(spark, tmp_path).run(stream(spark, tmp_path), to)
    assert to.got == WANT and to.calls == 3


def test_web_watches(spark, tmp_path):
    w, push = watching.WebWatch(spark, str(tmp_path)), lambda rows: rows.where("watch = 'w2' and tick = 2").select("watch")
    frame = lambda rows: spark.createDataFrame(rows, "watch string, urls array<string>, failed boolean")
    out = lambda df: {r.watch: (r.outcome, list(r.new)) for r in df.collect()}
    assert out(w.tick(frame([("w1", ["a", "b", "a"], False), ("w2", ["x"], False), ("w3", None, True)]), 1, 100, push)) == {"w1": ("baseline", []), "w2": ("baseline", []), "w3": ("failed", [])}
    again = [("w1", ["b", "c"], False), ("w2", ["y", "x"], False), ("w3", ["q"], True)]
    for _ in range(2):  # a tick that runs again
        assert out(w.tick(frame(again), 2, 200, push)) == {"w1": ("notified", ["c"]), "w2": ("failed", ["y"]), "w3": ("baseline", [])}
    assert out(w.tick(frame([("w1", ["a"], False), ("w2", ["y"], False)]), 3, 300, push)) == {"w1": ("unchanged", []), "w2": ("notified", ["y"])}
    every = spark.createDataFrame([("w1",), ("w2",), ("w3",), ("w4",)], "watch string")
    assert [r.watch for r in w.due(every, 350, 100, 9).collect()] == ["w4", "w3"]
    assert [r.watch for r in w.due(every, 400, 100, 2).collect()] == ["w4", "w3"]
