"""History as tables, by Python data sources over the git command line.

``git_log``, ``git_diff`` and ``git_blame`` read a working copy that the reading task can
open (the path must be visible where it runs).
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import COMMIT_WINDOW


def _git(path: str, *args: str) -> str:
    return subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=True, errors="replace").stdout


def read_log(path: str, window: int = COMMIT_WINDOW) -> Iterator[tuple]:
    """(sha, seq, author, message, committed_at, n_parents, file, old_path, status): newest first, single-parent commits with their files."""
    out = _git(path, "log", f"-n{4 * window}", "--date-order", "--name-status", "-M", "--format=%x01%H%x02%an%x02%ct%x02%P%x02%s%x02")
    seq = 0
    for block in out.split("\x01")[1:]:
        sha, author, at, parents, message, files = block.split("\x02", 5)
        n = len(parents.split())
        if n != 1:
            continue
        if seq >= window:
            return
        for line in files.strip("\n").split("\n"):
            parts = line.split("\t")
            if len(parts) >= 2:
                yield (sha, seq, author, message, int(at), n, parts[-1], parts[1] if len(parts) == 3 else None, parts[0][:1])
        seq += 1


def read_diff(path: str, base: str = "HEAD") -> Iterator[tuple]:
    """(module_path, from_line, to_line) of changed ranges against base; pure deletions give none."""
    file = None
    for line in _git(path, "diff", "-U0", "-M", base).split("\n"):
        if line.startswith("+++ "):
            file = line[6:] if line.startswith("+++ b/") else None
        elif line.startswith("@@") and file:
            m = re.match(r"@@ -\S+ \+(\d+)(?:,(\d+))? @@", line)
            start, n = int(m[1]), int(m[2] or 1)
            if n:
                yield (file, start, start + n - 1)


def read_blame(path: str, commit: str) -> Iterator[tuple]:
    """(fix, file, origin, lines): which commits last touched the lines that a commit removed, at its parent."""
    file = None
    counts: dict[tuple, int] = {}
    for line in _git(path, "diff", "-U0", "-M", f"{commit}^", commit).split("\n"):
        if line.startswith("--- "):
            file = line[6:] if line.startswith("--- a/") else None
        elif line.startswith("@@") and file:
            m = re.match(r"@@ -(\d+)(?:,(\d+))? ", line)
            start, n = int(m[1]), int(m[2] or 1)
            if n:
                for x in _git(path, "blame", "--porcelain", "-L", f"{start},{start + n - 1}", f"{commit}^", "--", file).split("\n"):
                    if h := re.match(r"([0-9a-f]{40}) \d+ \d+", x):
                        counts[(file, h[1])] = counts.get((file, h[1]), 0) + 1
    for (f, origin), n in counts.items():
        yield (commit, f, origin, n)


class _Source(DataSource):
    columns = ""

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.name(), dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.options["commits"].split(",") if c] if self.kind == "git_blame" else [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = self.options["path"]
        if self.kind == "git_log":
            yield from read_log(path, int(self.options.get("window", COMMIT_WINDOW)))
        elif self.kind == "git_diff":
            yield from read_diff(path, self.options.get("base", "HEAD"))
        else:
            yield from read_blame(path, partition.value)


class GitLog(_Source):
    columns = "sha string, seq int, author string, message string, committed_at long, n_parents int, file string, old_path string, status string"

    @classmethod
    def name(cls) -> str:
        return "git_log"


class GitDiff(_Source):
    columns = "module_path string, from_line int, to_line int"

    @classmethod
    def name(cls) -> str:
        return "git_diff"


class GitBlame(_Source):
    columns = "fix string, file string, origin string, lines long"

    @classmethod
    def name(cls) -> str:
        return "git_blame"


def register(spark: SparkSession) -> None:
    for source in (GitLog, GitDiff, GitBlame):
        spark.dataSource.register(source)


def history(spark: SparkSession, path: str, window: int = COMMIT_WINDOW) -> DataFrame:
    register(spark)
    return spark.read.format("git_log").option("path", path).option("window", window).load()


def changed_ranges(spark: SparkSession, path: str, base: str = "HEAD") -> DataFrame:
    register(spark)
    return spark.read.format("git_diff").option("path", path).option("base", base).load()


def blamed(spark: SparkSession, path: str, commits: list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("git_blame").option("path", path).option("commits", ",".join(commits)).load()
