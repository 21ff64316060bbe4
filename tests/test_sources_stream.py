"""The shared request budget, the feed as a stream, logs written once, and state that ends."""

import json
import os
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.sources import log, poll
from quillon.sources.lease import SharedLimiter
from quillon.streaming import dedup

T0 = datetime(2026, 9, 1)


class Clock:
    def __init__(self, now=1000.0):
        self.now, self.slept = now, 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds
        self.slept += seconds


# -- shared budget -------------------------------------------------------------------------------------


def test_limiters_of_two_processes_share_slots(tmp_path):
    clock = Clock()
    a, b = (SharedLimiter(str(tmp_path), 3, 0.05, clock=clock, sleep=clock.sleep) for _ in range(2))
    assert [round(x.reserve(), 3) for x in (a, b, a, b)] == [0, 3.05, 6.1, 9.15]
    clock.now += 100
    assert b.reserve() == 0  # idle time is no credit
    assert round(a.wait(), 3) == 3.05 and round(clock.slept, 3) == 3.05


def test_slots_are_distinct_under_contention(tmp_path):
    clock, waits, lock = Clock(), [], threading.Lock()

    def run():
        own = SharedLimiter(str(tmp_path), 1, 0, clock=clock)
        for _ in range(15):
            wait = own.reserve()
            with lock:
                waits.append(round(wait, 3))

    threads = [threading.Thread(target=run) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(waits) == list(range(60)) and len(os.listdir(tmp_path)) <= 8 + 4


def test_a_slot_of_long_ago_counts_no_more(tmp_path):
    clock = Clock()
    own = SharedLimiter(str(tmp_path), 3, 0, ttl_s=50, clock=clock)
    assert [own.reserve() for _ in range(3)] == [0, 3, 6]
    clock.now += 57
    assert own.reserve() == 0


def test_without_the_folder_the_process_limits_itself(tmp_path):
    (tmp_path / "file").write_text("x")
    clock = Clock()
    own = SharedLimiter(str(tmp_path / "file" / "under"), 3, 0, clock=clock, sleep=clock.sleep)
    assert [own.reserve() for _ in range(3)] == [0, 3, 6] and own.fell_back == 3


# -- the feed as a stream ------------------------------------------------------------------------------


def entry(key, updated):
    return f"""<entry><id>http://arxiv.org/abs/{key}v1</id><updated>{updated}</updated><published>{updated}</published><title>T {key}</title><summary>S</summary><author><name>A</name></author>
<link href="http://arxiv.org/abs/{key}v1" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/{key}v1"/><arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="cs.CV"/><category term="cs.CV"/></entry>"""


def write_feed(folder, category, keys, size=2):
    """Pages of a feed, newest first; keys are minutes."""
    os.makedirs(f"{folder}/{category}", exist_ok=True)
    keys = sorted(keys, reverse=True)
    for start in range(0, len(keys), size):
        own = "".join(entry(f"2609.{k:05d}", (T0 + timedelta(minutes=k)).strftime("%Y-%m-%dT%H:%M:%SZ")) for k in keys[start : start + size])
        xml = f'<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"><opensearch:totalResults>{len(keys)}</opensearch:totalResults>{own}</feed>'
        with open(f"{folder}/{category}/{start}.xml", "w") as f:
            f.write(xml)


def test_each_paper_comes_once_over_restarts(spark, tmp_path):
    folder = str(tmp_path / "feed")

    def run():
        df = poll.papers_stream(spark, folder, ["a", "b"], page_size=2, pages=10, budget=str(tmp_path / "budget"), interval=0.0)
        query = log.produce(df, str(tmp_path / "log"), "papers", "feed", str(tmp_path / "check"), F.lit(T0)).trigger(availableNow=True).start()
        query.awaitTermination()

    write_feed(folder, "a", [1, 2, 3, 4, 5])
    write_feed(folder, "b", [7])
    run()
    write_feed(folder, "a", [1, 2, 3, 4, 5, 6, 8, 9])
    run()
    run()
    rows = log.read_all(spark, str(tmp_path / "log"), "papers").collect()
    assert sorted(r.key for r in rows) == [f"2609.{k:05d}v1" for k in range(1, 10)]
    assert all(json.loads(r.value)["arxiv_id"] == r.key[:-2] for r in rows)
    for p in {r.partition for r in rows}:  # offsets of a partition have no gap
        assert sorted(r.offset for r in rows if r.partition == p) == list(range(sum(r.partition == p for r in rows)))
    assert len(os.listdir(tmp_path / "budget")) >= 1


def test_busy_pages_are_asked_for_again(tmp_path):
    calls = []

    class Busy(poll.FeedReader):
        def fetch(self, category, start):
            calls.append(start)
            if len(calls) < 3:
                raise poll.Transient("503")
            return None

    reader = Busy({"categories": "a", "folder": str(tmp_path), "pauses": "0,0"})
    assert reader.page("a", 0) is None and calls == [0, 0, 0]

    class Down(poll.FeedReader):
        def fetch(self, category, start):
            raise poll.Transient("503")

    with pytest.raises(RuntimeError, match="3 tries"):
        Down({"categories": "a", "folder": str(tmp_path), "pauses": "0,0"}).page("a", 0)


# -- logs ----------------------------------------------------------------------------------------------


def test_a_batch_is_added_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = log.records(spark.createDataFrame([(f"k{k}", str(k)) for k in range(40)], "key string, value string"), "t", F.lit(T0))
    assert log.append_batch(rows, path, "w", 0) and not log.append_batch(rows, path, "w", 0)
    assert log.append_batch(rows.limit(3), path, "v", 0)
    assert log.read_all(spark, path).count() == 43
    os.remove(f"{path}/writer=v/batch=0/_SUCCESS")  # as if the writer had broken off
    assert log.append_batch(rows.limit(5), path, "v", 0) and log.read_all(spark, path).count() == 45


def test_offsets_follow_arrival_in_each_partition(spark):
    messages = spark.createDataFrame([(f"k{k % 17}", str(k), k) for k in range(500)], "key string, value string, arrival long").repartition(5)
    rows = log.records(messages, "t", F.lit(T0)).collect()
    for p in range(log.PARTITIONS):
        own = sorted((r.offset, int(r.value)) for r in rows if r.partition == p)
        assert [o for o, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)


# -- state that ends -----------------------------------------------------------------------------------


def stream_of(spark, tmp_path, parts, ddl):
    path = str(tmp_path / "in")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def collect(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    rows = [x for p in query.recentProgress for x in p.stateOperators]
    query.stop()
    return df.sparkSession.table(name).collect(), rows


def test_dwell_state_ends_when_idle(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    parts = [[(1, 1, at(0), True), (1, 1, at(12), False)], [(1, 1, at(20), True), (1, 1, at(40), False)], [(9, 9, at(7200), True)], [(9, 9, at(7300), False), (1, 1, at(7200), True), (1, 1, at(7215), False)], [(8, 8, at(20000), True)], [(8, 8, at(20001), False)]]
    df = dedup.dwell_sessions(stream_of(spark, tmp_path, parts, "user_id long, paper_id long, ts timestamp, visible boolean"), "1 minute")
    got, state = collect(df, "dwell_ends")
    assert sorted((r.user_id, r.seconds) for r in got) == [(1, 12.0), (1, 15.0), (9, 100.0)]  # told once a visit; anew after the pause
    assert state[-1].numRowsTotal <= 4  # the two pages that ended long ago are forgotten


def answers(df, name, wanted):
    """A stream whose state has processing-time expiry goes on by itself: it is stopped when the wanted questions are answered."""
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for _ in range(120):
            rows = df.sparkSession.table(name).collect()
            if {r.query_id for r in rows} >= wanted or query.exception():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    return {r.query_id: r.response for r in rows}


def test_cached_answers_live_for_their_time(spark, tmp_path):
    parts = [
        [("s", 0, [1.0, 0.0], "right", 1), ("s", 1, [1.0, 0.05], None, 2), ("s", 2, [0.0, 1.0], None, 3), ("other", 3, [1.0, 0.0], None, 4)],
        [("s", 4, [1.0, 0.0], None, 5), ("s", 0, [1.0, 0.01], "righter", 6), ("s", 5, [1.0, 0.01], None, 7)],
    ]
    ddl = "scope string, query_id long, vector array<double>, response string, at long"
    got = answers(dedup.cache_stream(stream_of(spark, tmp_path, parts, ddl), 3600), "cached", {1, 2, 3, 4, 5})
    assert got == {1: "right", 2: None, 3: None, 4: "right", 5: "righter"}
    short = stream_of(spark, tmp_path / "short", parts[:1] + [[("s", 6, [1.0, 0.0], None, 9)]], ddl)
    assert answers(dedup.cache_stream(short, 0.001), "cached_short", {6})[6] is None
