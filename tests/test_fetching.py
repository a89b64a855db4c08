"""Fetched pages and polled feeds through local openers."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quarry.sources import fetching


def test_a_partition_for_each_host(spark, tmp_path):
    log = str(tmp_path / "log")

    def opener(url):
        import os
        import time

        with open(log, "a") as f:
            f.write(f"{time.time()} {os.getpid()} {url}\n")
        return (200, f"<p>{url}</p>") if "gone" not in url else (404, None)

    urls = [(f"http://h{i % 3}/p{i}",) for i in range(9)] + [("http://h0/gone",), ("http://h0/p0",), (None,), ("no url",)]
    df = fetching.fetched(spark.createDataFrame(urls, "url string").repartition(4), opener, retries=2, delay=0.05)
    assert df.rdd.getNumPartitions() == 4
    got = {r["url"]: (r["status"], r["html"], r["attempts"]) for r in df.collect()}
    assert got.pop("http://h0/gone") == (404, None, 2) and len(got) == 10 and all(v == (200, f"<p>{u}</p>", 1) for u, v in got.items())
    asked = [x.split(" ", 2) for x in open(log).read().splitlines()]
    for host in ("h0", "h1", "h2"):
        times = sorted(float(t) for t, _, u in asked if f"//{host}/" in u)
        assert all(b - a >= 0.045 for a, b in zip(times, times[1:]))


def test_waits_between_tries():
    waits, answers = [], iter([429, 429, 500, 200])
    assert fetching.get("u", lambda u: (next(answers), "x"), 4, 1.0, waits.append) == ("u", 200, "x", 4) and waits == [1.0, 2.0, 1.0]

    def broken(url):
        raise OSError

    assert fetching.get("u", broken, 2, 1.0, waits.append) == ("u", 0, None, 2)


def test_a_feed_replays_the_same_rows_after_a_failure(spark, tmp_path):
    feed = str(tmp_path / "feed.jsonl")

    def opener(at, n):
        import json

        with open(feed) as f:
            return [json.loads(x) for x in f.read().splitlines()[at : at + n]]

    put = lambda rows: open(feed, "a").write("".join(json.dumps(r) + "\n" for r in rows))
    put([{"station": f"s{i}", "t": i} for i in range(7)])
    seen, fail = [], [True]

    def sink(df, i):
        rows = [(i, r["at"], r["record"]) for r in df.collect()]
        seen.extend(rows)
        if fail and any(r[1] >= 4 for r in rows):
            fail.clear()
            raise RuntimeError("lost")

    def run():
        q = fetching.polled(spark, opener, most=4).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(sink).trigger(processingTime="200 milliseconds").start()
        try:
            for _ in range(100):
                time.sleep(0.2)
                if not q.isActive or (not fail and len({r[1] for r in seen}) >= want):
                    break
        finally:
            q.stop()

    want = 7
    run()
    assert not fail
    put([{"station": "late", "t": 9}])  # lands before the batch is tried again, and isn't part of it
    want = 8
    run()
    again = [r for r in seen if r[0] == 1]
    assert sorted(set(again)) == again[: len(again) // 2] == again[len(again) // 2 :] and [r[1] for r in again[:3]] == [4, 5, 6]
    assert sorted({r[1] for r in seen}) == list(range(8)) and json.loads(seen[-1][2]) == {"station": "late", "t": 9}


@pytest.mark.parametrize("n", [0])
def test_nothing_to_fetch(spark, n):
    assert fetching.fetched(spark.createDataFrame([], "url string"), lambda u: (200, ""), delay=0).select(F.count(F.lit(1))).first()[0] == n
