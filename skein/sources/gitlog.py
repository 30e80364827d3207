"""Commits of a checkout as a Python data source, in batches and as a stream.

A partition is a range of commits, told by how many to pass over and how many to take, so neither the log nor the list of
commits is ever on the driver, and a lost task reads its range again. The stream's offset is a commit: each trigger
reads what lies between the last one and the branch's present head, so pulls one after the other give the same rows as one.
Executors need the checkout at the same path.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COMMIT_SCHEMA = "commit_hash string, author string, author_email string, commit_date timestamp, message string, file_path string, additions long, deletions long"
COMMITS_A_PARTITION = 1000
_LOG = ("log", "--first-parent", "-m", "--numstat", "--no-renames", "--format=%x01%H%x02%an%x02%ae%x02%ct%x02%s")


def _git(checkout: str, *words: str) -> str:
    return subprocess.run(["git", "-C", checkout, *words], capture_output=True, text=True, check=True).stdout.strip()


@dataclass
class Commits(InputPartition):
    """Of the commits of a range, newest first, ``take`` after the first ``skip``."""

    span: str
    skip: int
    take: int


class _Ranges:
    def __init__(self, options: dict):
        self.checkout = options["path"]
        self.step = int(options.get("commits_a_partition", COMMITS_A_PARTITION))

    def head(self, revision: str) -> str:
        return _git(self.checkout, "rev-parse", "--verify", f"{revision}^{{commit}}")

    def ranges(self, old: str, new: str) -> list[Commits]:
        """Ranges of the commits of new that old does not have; all of new's without old."""
        span = f"{old}..{new}" if old else new
        n = int(_git(self.checkout, "rev-list", "--count", "--first-parent", span))
        return [Commits(span, k, self.step) for k in range(0, n, self.step)]

    def read(self, partition: Commits) -> Iterator[tuple]:
        """A row for each commit and changed file against the first parent, as git prints them; one commit is held at a time."""
        command = ["git", "-C", self.checkout, *_LOG, f"--skip={partition.skip}", f"--max-count={partition.take}", partition.span]
        with subprocess.Popen(command, stdout=subprocess.PIPE, text=True, encoding="utf-8", errors="replace") as process:
            head: tuple = ()
            for line in process.stdout:
                line = line.rstrip("\n")
                if line.startswith("\x01"):
                    commit, author, email, at, message = line[1:].split("\x02", 4)
                    head = (commit, author, email, datetime.fromtimestamp(int(at), UTC), message)
                elif line:
                    added, removed, path = line.split("\t", 2)
                    yield (*head, path, *(int(x) if x != "-" else 0 for x in (added, removed)))
        if process.returncode:
            raise RuntimeError(f"git log ended with {process.returncode}")


class _Reader(_Ranges, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.old, self.new = options.get("since", ""), options.get("revision", "HEAD")

    def partitions(self) -> list[Commits]:
        return self.ranges(self.head(self.old) if self.old else "", self.head(self.new))


class _StreamReader(_Ranges, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.since, self.revision = options.get("since", ""), options.get("revision", "HEAD")

    def initialOffset(self) -> dict:
        return {"commit": self.head(self.since) if self.since else ""}

    def latestOffset(self) -> dict:
        return {"commit": self.head(self.revision)}

    def partitions(self, start: dict, end: dict) -> list[Commits]:
        return self.ranges(start["commit"], end["commit"])

    def commit(self, end: dict) -> None:
        pass


class GitLog(DataSource):
    """Options: path, revision (HEAD), since (a commit; all without one), commits_a_partition."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return COMMIT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def _given(source, checkout: str, revision: str, since: str | None):
    return source.format("git_log").option("revision", revision).option("since", since or "").load(checkout)


def git_log(spark: SparkSession, checkout: str, revision: str = "HEAD", since: str | None = None) -> DataFrame:
    """A row per commit and changed file of the revision, only of commits that ``since`` does not have if given."""
    spark.dataSource.register(GitLog)
    return _given(spark.read, checkout, revision, since)


def git_stream(spark: SparkSession, checkout: str, revision: str = "HEAD", since: str | None = None) -> DataFrame:
    """The same as a stream: each trigger gives the commits that are new."""
    spark.dataSource.register(GitLog)
    return _given(spark.readStream, checkout, revision, since)


def pull(spark: SparkSession, checkout: str, table: str, log: str) -> None:
    """Appends the commits since the last pull to a table; ``log`` is where the stream keeps what it has read."""
    query = git_stream(spark, checkout).writeStream.format("parquet").option("path", table).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()


def changed_files(commits: DataFrame) -> DataFrame:
    """(file_path, commits, additions, deletions) over some commits: the work of an incremental run."""
    from pyspark.sql import functions as F

    return commits.groupBy("file_path").agg(F.countDistinct("commit_hash").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
