"""Rate limits, change monitors, caches, counters and the state of jobs: queries with their SQL."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.operators import relational as R
from quarry.plans.catalogue import load, query
from quarry.streaming import windows as S

#: Seconds that values of each kind live: fixed values.
TTL = {"default": 3600, "search": 300, "embedding": 86_400, "session": 3600, "job": 86_400}

_PATH = "CASE event_type WHEN 'view' THEN '/api/v1/chat/x' WHEN 'click' THEN '/api/v1/search' WHEN 'error' THEN '/api/v1/scraper/start' ELSE '/other' END"
_LIMIT = "CASE " + " ".join(f"WHEN starts_with(path, '{p}') THEN {n}" for p, n in fixed.RATE_LIMITS) + f" ELSE {fixed.DEFAULT_LIMIT} END"


@query(f"""WITH r AS (SELECT event_id, user_id % 3 AS client, {_PATH} AS path, ts FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY client, path, date_trunc('day', ts) ORDER BY ts, event_id) AS rank FROM r) SELECT event_id, path, rank, rank <= {_LIMIT} AS allowed FROM k""")
def rate_limit_by_endpoint(s, d):
    """Ranks within client, endpoint and window; the first prefix that fits gives the limit."""
    r = load(s, d, "events").withColumn("client", F.col("user_id") % 3).withColumn("path", F.expr(_PATH))
    return S.rate_limit_by_endpoint(r, "client", "path", "ts", "event_id", "day").select("event_id", "path", "rank", "allowed")


@query("SELECT event_id, url, hash FROM (SELECT event_id, 'http://h/' || user_id AS url, md5(event_type) AS hash, lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND b <> hash")
def url_change_monitor(s, d):
    """Fetches of a url whose content hash differs from the one before."""
    f = load(s, d, "events").select("event_id", "ts", F.concat(F.lit("http://h/"), F.col("user_id").cast("string")).alias("url"), F.md5(F.col("event_type").cast("binary")).alias("hash"))
    return S.changes(f, "url", "hash", "ts", "event_id").select("event_id", "url", "hash")


@query(f"""WITH p AS (SELECT *, CASE event_type WHEN 'click' THEN {TTL['search']} WHEN 'view' THEN {TTL['embedding']} WHEN 'error' THEN 0 ELSE {TTL['default']} END AS ttl FROM events), n AS (SELECT max(ts) AS now FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM p) SELECT user_id, event_id, ttl FROM l, n WHERE rn = 1 AND (ttl <= 0 OR ts + to_seconds(ttl) > now)""")
def ttl_cache(s, d):
    """The last value of each key if it hasn't expired; a time of 0 never does."""
    t = F.col("event_type")
    e = load(s, d, "events").withColumn("ttl", F.when(t == "click", TTL["search"]).when(t == "view", TTL["embedding"]).when(t == "error", 0).otherwise(TTL["default"]))
    now = load(s, d, "events").agg(F.max("ts").alias("now"))
    return S.live(R.first_by(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]), now, "ts", "ttl").select("user_id", "event_id", "ttl")


@query("""WITH o AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 3) AS head, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT event_type AS x FROM events e WHERE e.user_id = o.user_id)) AS members, sum(CASE event_type WHEN 'click' THEN 2 ELSE 1 END)::BIGINT AS counter FROM o GROUP BY user_id""")
def store_values(s, d):
    """Lists (the last three pushed), sets and counters by key."""
    e = load(s, d, "events").withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "event_id")))), lambda x: x["event_id"].cast("string")), ",")
    return e.groupBy("user_id").agg(head.alias("head"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("members"), F.sum(F.when(F.col("event_type") == "click", 2).otherwise(1)).alias("counter"))


@query("SELECT user_id, event_type AS field, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY ALL")
def store_hashes(s, d):
    """The last value of each field of each key."""
    return load(s, d, "events").groupBy("user_id", F.col("event_type").alias("field")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("value"))


class ResultCache:
    """Results of queries by name and parameters for ``seconds``; errors and empty results aren't kept.

    Entries are cached DataFrames; of more than ``most`` the oldest is let go.
    """

    def __init__(self, seconds: float = 300, most: int = 32, clock: Callable[[], float] | None = None):
        import time

        self.seconds, self.most, self.clock = seconds, most, clock or time.monotonic
        self.held: dict[str, tuple[float, DataFrame]] = {}

    @staticmethod
    def key(name: str, params: dict[str, object]) -> str:
        return hashlib.md5(json.dumps([name, params], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, name: str, params: dict[str, object], make: Callable[[], DataFrame]) -> DataFrame:
        k, now = self.key(name, params), self.clock()
        if k in self.held and self.held[k][0] > now:
            return self.held[k][1]
        if k in self.held:
            self.held.pop(k)[1].unpersist()
        df = make().persist()
        if df.isEmpty():
            df.unpersist()
            return df
        while len(self.held) >= self.most:
            self.held.pop(next(iter(self.held)))[1].unpersist()
        self.held[k] = (now + self.seconds, df)
        return df


#: Steps of a job and the progress after each: fixed values.
STEPS = (("scraping", 0.2), ("processing", 0.4), ("embedding", 0.6), ("storing", 0.8), ("indexing", 1.0))


class Job:
    """A job's state: runs its steps in order, tells callbacks, can pause between steps and resume, and fails with the error's text."""

    def __init__(self, steps: dict[str, Callable[[object], object]], callbacks: tuple[Callable[[str, float], None], ...] = ()):
        unknown = set(steps) - {n for n, _ in STEPS}
        if unknown:
            raise ValueError(f"unknown steps: {sorted(unknown)}")
        self.steps, self.callbacks = steps, callbacks
        self.status, self.progress, self.error, self.result = "pending", 0.0, None, None
        self.paused, self.done = False, 0

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False
        if self.status == "paused":
            self.run()

    def run(self) -> str:
        self.status = "running"
        while self.done < len(STEPS):
            if self.paused:
                self.status = "paused"
                return self.status
            name, progress = STEPS[self.done]
            try:
                if name in self.steps:
                    self.result = self.steps[name](self.result)
            except Exception as e:  # a step's failure is the job's state
                self.status, self.error = "failed", f"{name}: {e}"
                return self.status
            self.done, self.progress = self.done + 1, progress
            for tell in self.callbacks:
                tell(name, progress)
        self.status = "completed"
        return self.status


@query("""SELECT doc_id, length(text) AS n_chars, md5(text) AS content_hash, CASE WHEN text IS NULL OR trim(text) = '' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE (length(text) + 799) // 800 END AS chunks FROM documents WHERE coalesce(octet_length(encode(text)), 0) <= 10485760""")
def upload_pipeline(s, d):
    """Bytes decoded, hashed, cut into chunks of 1000 characters, with a status."""
    from quarry.functions import text as X

    raw = load(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    t = raw.where(F.coalesce(F.octet_length("content"), F.lit(0)) <= 10 * 1024 * 1024).withColumn("text", F.decode("content", "UTF-8"))
    status = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "failed").otherwise("completed")
    return t.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("content_hash"), status.alias("status"), F.coalesce(F.size(X.stride_chunks(F.col("text"))), F.lit(0)).cast("long").alias("chunks"))


_UPLOADS = "u AS (SELECT doc_id, n_chars * 400 AS file_size, CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' END AS content_type FROM documents)"


@query(f"WITH {_UPLOADS} SELECT doc_id, file_size FROM u WHERE content_type IN ('text/plain', 'application/pdf') AND file_size <= {10 * 1024 * 1024}")
def upload_gate(s, d):
    """Uploads of a known type within the size limit; those without a type are refused."""
    from quarry.sources.tables import admissible

    k = F.col("doc_id") % 4
    u = load(s, d, "documents").select("doc_id", (F.col("n_chars") * 400).alias("file_size"), F.when(k == 0, "text/plain").when(k == 1, "application/pdf").when(k == 2, "image/png").alias("content_type"))
    return admissible(u).select("doc_id", "file_size")
