"""Tables of which a reader sees one version, whole, whatever writers do meanwhile.

A version is a small JSON entry, <path>/_versions/<number>.json, that names the folders it
consists of; the folders are written first and never changed. An entry appears at once and only
if no other has its number: by a rename that fails where the target exists, on local disks by a
hard link. A writer states the version it started from, so that of two writers from one version
the second fails (Conflict). Readers take the newest entry, or one by number; folders that no
kept version names are deleted by vacuum.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Version:
    """number 0 is the table before any version. folders: what it consists of; notes: what the table's users keep with it."""

    number: int = 0
    folders: tuple[str, ...] = ()
    notes: dict[str, Any] = field(default_factory=dict)


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _child(spark: SparkSession, path: str, *names: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *names]))


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, oldest first."""
    system, _ = _system(spark, path)
    log = _child(spark, path, "_versions")
    if not system.exists(log):
        return []
    found = (x.getPath().getName() for x in system.listStatus(log))
    return sorted(int(n.removesuffix(".json")) for n in found if n.endswith(".json") and not n.startswith("."))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version by number, or the newest."""
    if number is None:
        there = numbers(spark, path)
        if not there:
            return Version()
        number = there[-1]
    if number == 0:
        return Version()
    system, _ = _system(spark, path)
    stream = system.open(_child(spark, path, "_versions", f"{number:012d}.json"))
    try:
        entry = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(number, tuple(entry["folders"]), entry["notes"])


def commit(spark: SparkSession, path: str, former: Version, folders: list[str] | tuple[str, ...], notes: dict[str, Any] | None = None) -> Version:
    """Make the version after former; Conflict if there is one already."""
    made = Version(former.number + 1, tuple(folders), notes or {})
    system, _ = _system(spark, path)
    log = _child(spark, path, "_versions")
    system.mkdirs(log)
    hidden = _child(spark, path, "_versions", f".{uuid.uuid4().hex}")
    shown = _child(spark, path, "_versions", f"{made.number:012d}.json")
    out = system.create(hidden, False)
    try:
        out.write(bytearray(json.dumps({"folders": list(made.folders), "notes": made.notes}).encode()))
    finally:
        out.close()
    try:
        _shown(spark, system, hidden, shown)
    except Exception as error:
        if system.exists(shown):
            raise Conflict(f"{path}: version {made.number} was made by another writer") from error
        raise
    finally:
        system.delete(hidden, False)
    return made


def _shown(spark: SparkSession, system, hidden, shown) -> None:
    jvm = spark.sparkContext._jvm
    if system.getUri().getScheme() == "file":
        files = jvm.java.nio.file
        files.Files.createLink(files.Path.of(shown.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), files.Path.of(hidden.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)))
        return
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context.rename(hidden, shown, none)


def fresh(name: str = "data") -> str:
    """A name for a folder that no version has yet."""
    return f"{name}-{uuid.uuid4().hex}"


def paths(path: str, made: Version) -> list[str]:
    return [f"{path.rstrip('/')}/{f}" for f in made.folders]


def replace(df: DataFrame, path: str, former: Version | None = None, write: Callable[[DataFrame, str], None] | None = None) -> Version:
    """df as the next version, in place of all the table held; former: the version it was made from (by default the newest now)."""
    spark = df.sparkSession
    former = version(spark, path) if former is None else former
    name = fresh()
    at = f"{path.rstrip('/')}/{name}"
    (write or (lambda x, to: x.write.parquet(to)))(df, at)
    return commit(spark, path, former, [name], former.notes)


def read(spark: SparkSession, path: str, schema: Any, number: int | None = None) -> DataFrame:
    """The rows of a version; none before the first."""
    made = version(spark, path, number)
    return spark.read.schema(schema).parquet(*paths(path, made)) if made.folders else spark.createDataFrame([], schema)


def changed(spark: SparkSession, path: str, schema: Any, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> Version:
    """The next version as a change of the newest; made anew from the newer one if another writer came first."""
    for k in range(tries):
        former = version(spark, path)
        try:
            return replace(change(read(spark, path, schema, former.number)), path, former)
        except Conflict:
            if k == tries - 1:
                raise
    raise AssertionError


def added(df: DataFrame, path: str, tries: int = 20) -> Version:
    """The next version with df's rows beside all that is there; writers that only add don't hinder each other."""
    name = fresh("added")
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    for k in range(tries):
        former = version(df.sparkSession, path)
        try:
            return commit(df.sparkSession, path, former, [*former.folders, name], former.notes)
        except Conflict:
            if k == tries - 1:
                raise
    raise AssertionError


def vacuum(spark: SparkSession, path: str, keep: int = 5, older_than_secs: float = 3600) -> list[str]:
    """Delete versions but the last keep, and folders that none of those names and that are old enough to be no writer's work; what went."""
    system, root = _system(spark, path)
    there = numbers(spark, path)
    kept = {f for n in there[-keep:] for f in version(spark, path, n).folders}
    oldest = (time.time() - older_than_secs) * 1000
    gone = []
    for n in there[:-keep]:
        system.delete(_child(spark, path, "_versions", f"{n:012d}.json"), False)
    for x in system.listStatus(root):
        name = x.getPath().getName()
        if x.isDirectory() and (not name.startswith("_") or "=" in name) and name not in kept and x.getModificationTime() <= oldest:
            system.delete(x.getPath(), True)
            gone.append(name)
    return sorted(gone)
