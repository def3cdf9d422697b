"""Descriptions by a text provider, with a cache of its answers."""

from __future__ import annotations

import contextlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colmeta.functions.text import EXCERPT_CHARS, cache_key, parsed_answer, prompt

CACHE = "cache_key string, context_excerpt string, variables array<string>, response string, version int, timestamp timestamp, provider string"


def requests(contexts: DataFrame) -> DataFrame:
    """Requests of (table_id, provider, context, variables) rows, with cache_key and prompt."""
    return contexts.withColumns({"cache_key": cache_key(F.col("provider"), F.col("context"), F.col("variables")), "prompt": prompt(F.col("context"), F.col("variables"))})


def looked_up(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached response, null where there is none."""
    return asked.join(cache.select("cache_key", F.col("response").alias("cached")), "cache_key", "left")


def distinct_requests(asked: DataFrame) -> DataFrame:
    """One row for each cache_key among requests: cache_key, provider, context, variables, prompt."""
    one = asked.groupBy("cache_key").agg(F.min(F.struct("provider", "context", "variables", "prompt")).alias("r"))
    return one.select("cache_key", "r.*")


class _Journal:
    """Answers of one round of requests as they arrive: a file for each key, which appears whole or not at all."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path)
        self.missing = fs.FileType.NotFound

    def _at(self, key: str) -> str:
        return f"{self.path}/{key[:2]}/{key}"

    def read(self, key: str) -> dict | None:
        if self.files.get_file_info(self._at(key)).type == self.missing:
            return None
        with self.files.open_input_stream(self._at(key)) as f:
            return json.loads(f.read())

    def write(self, key: str, said: dict) -> None:
        part = f"{self._at(key)}.{uuid.uuid4().hex}"
        self.files.create_dir(part.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(said).encode())
        self.files.move(part, self._at(key))


def _asked(provider: Callable[[str, str], str], name: str, prompt: str, retries: int, wait: float) -> dict:
    """The provider's answer, or what was wrong with the last of 1 + retries calls, and how many calls were made."""
    error = None
    for attempt in range(1, retries + 2):
        try:
            return {"response": provider(name, prompt), "error": None, "attempts": attempt}
        except Exception as e:  # a provider may raise anything; that is a row's outcome, not the job's
            error = f"{type(e).__name__}: {e}"
            if wait and attempt <= retries:
                time.sleep(wait * 2 ** (attempt - 1))
    return {"response": None, "error": error, "attempts": retries + 1}


def generated(missing: DataFrame, provider: Callable[[str, str], str], retries: int = 2, wait: float = 0.0, journal: str | None = None) -> DataFrame:
    """Requests without an answer with response, error and attempts; provider(name, prompt) is called for each row.

    A call that raises is made again, at most `retries` times, after wait, 2 * wait, 4 * wait, ... seconds. A request whose
    calls all raised has a null response and the last error; it stops no other. journal: a folder that all tasks share
    (file, hdfs or s3), where each answer is kept the moment it arrives under the request's cache_key; a task that runs
    again, whatever ended it, reads them there and calls only for the rest. Failures are not kept there. Of two tasks
    that run at the same time for the same request, as in speculation, both may call.

    Workers get keys, names and prompts a hundred at a time, and no contexts.
    The calls happen wherever the result is computed: write it (store.written) before using it more than once.
    """

    kept: list[_Journal] = []  # opened by the worker

    def ask(key: str, name: str, prompt: str) -> tuple[str | None, str | None, int]:
        if journal and not kept:
            kept.append(_Journal(journal))
        said = kept[0].read(key) if kept else None
        if said is None:
            said = _asked(provider, name, prompt, retries, wait)
            if kept and said["error"] is None:
                kept[0].write(key, said)
        return said["response"], said["error"], said["attempts"]

    said = F.udf(ask, "response string, error string, attempts int", useArrow=False).asNondeterministic()  # never called twice for a row
    got = missing.withColumn("__said", said("cache_key", "provider", "prompt"))
    return got.select(*missing.columns, "__said.response", "__said.error", "__said.attempts")


def upserted(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers: a known key's version rises by one, the context is cut to its excerpt."""
    new = answers.groupBy("cache_key").agg(F.max_by(F.struct("context", "variables", "response", "provider"), "response").alias("n"))
    both = cache.alias("o").join(new, "cache_key", "full_outer")
    fresh = F.col("n").isNotNull()
    pick = lambda new, old: F.when(fresh, new).otherwise(F.col(f"o.{old}"))
    return both.select(
        "cache_key",
        pick(F.substring("n.context", 1, EXCERPT_CHARS), "context_excerpt").alias("context_excerpt"),
        pick(F.col("n.variables"), "variables").alias("variables"),
        pick(F.col("n.response"), "response").alias("response"),
        pick(F.coalesce(F.col("o.version"), F.lit(0)) + 1, "version").cast("int").alias("version"),
        pick(F.current_timestamp(), "timestamp").alias("timestamp"),
        pick(F.col("n.provider"), "provider").alias("provider"),
    )


def described(answers: DataFrame) -> DataFrame:
    """A row for each variable of each answer: table_id, name, description; answers without a JSON object give parse_error rows."""
    got = answers.withColumn("found", parsed_answer(F.col("response")))
    error = F.col("found").isNull()
    parts = got.select("table_id", error.alias("parse_error"), F.explode_outer("found").alias("name", "description"))
    return parts.select("table_id", "name", "description", "parse_error")


class CacheConflict(RuntimeError):
    """Another writer has committed a version since the base was read."""


#: Versions of a stored cache that stay readable behind a new one, and commits that an upsert tries.
KEPT, TRIES = 2, 20
_COMMIT = re.compile(r"[0-9]{10}")


class _Store:
    """A cache in a folder: tables under data, and for each version a small file under commits that names its table.

    A version exists once its commit file does. The file is made whole elsewhere and then given its name, which fails if
    another writer has taken it; that is atomic on HDFS and, by a link, on local and NFS folders.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self.at(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []

    def newest(self) -> int:
        """Number of the last version, 0 if there is none."""
        return max((int(n) for n in self._names("commits") if _COMMIT.fullmatch(n)), default=0)

    def _commit(self, version: int) -> str:
        return f"{self.path}/commits/{version:010d}"

    def table(self, version: int) -> str:
        with contextlib.closing(self.files.open(self.at(self._commit(version)))) as f:
            return bytes(f.readAllBytes()).decode()

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(CACHE).parquet(f"{self.path}/data/{self.table(version)}") if version else self.spark.createDataFrame([], CACHE)

    def write(self, cache: DataFrame) -> str:
        name = uuid.uuid4().hex
        cache.select(*(c.split()[0] for c in CACHE.split(", "))).write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, name: str, version: int) -> bool:
        """Make the table the given version, if that isn't taken."""
        part, target = self.at(f"{self.path}/commits/.{name}"), self.at(self._commit(version))
        with contextlib.closing(self.files.create(part, True)) as f:
            f.write(bytearray(name.encode()))
        try:
            if self.files.getScheme() == "file":
                os.link(part.toUri().getPath(), target.toUri().getPath())
                return True
            options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
            none = self.spark.sparkContext._gateway.new_array(options, 1)
            none[0] = options.NONE  # fails where the target exists
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri()).rename(part, target, none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError:
            if self.files.exists(target):
                return False
            raise
        finally:
            self.files.delete(part, False)

    def drop(self, name: str) -> None:
        self.files.delete(self.at(f"{self.path}/data/{name}"), True)

    def clear(self, newest: int) -> None:
        """Delete versions older than the last KEPT before the newest."""
        for n in sorted(int(x) for x in self._names("commits") if _COMMIT.fullmatch(x)):
            if n < newest - KEPT:
                name = self.table(n)
                self.files.delete(self.at(self._commit(n)), False)
                self.drop(name)


def cache_version(spark: SparkSession, path: str) -> int:
    """Number of the stored cache's last version, 0 where there is none."""
    return _Store(spark, path).newest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The last version of the cache at path, empty where there is none. It stays readable while KEPT more are written."""
    store = _Store(spark, path)
    return store.read(store.newest())


def store_cache(cache: DataFrame, path: str, base: int | None = None) -> int:
    """Write the cache as the version after base (the last one, if not given); readers see it when it is complete.

    CacheConflict if that version has been committed meanwhile: nothing of another writer is ever overwritten.
    """
    store = _Store(cache.sparkSession, path)
    base = store.newest() if base is None else base
    name = store.write(cache)
    if not store.commit(name, base + 1):
        store.drop(name)
        raise CacheConflict(f"version {base + 1} of {path} is there already")
    store.clear(base + 1)
    return base + 1


def upsert_cache(answers: DataFrame, path: str) -> int:
    """Add answers to the cache at path as upserted() does; of several writers at once each adds its own to the others'.

    The merge is made again on the version that came between, if there is one. answers should be stored: they are read again then.
    """
    store = _Store(answers.sparkSession, path)
    for _ in range(TRIES):
        base = store.newest()
        try:
            return store_cache(upserted(store.read(base), answers), path, base)
        except CacheConflict:
            continue
    raise CacheConflict(f"{TRIES} commits to {path} met others")
