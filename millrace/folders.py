"""Folders that change in one step.

Replacing. Each run writes a folder of its own below ``_runs``; then one empty file below ``_published``, whose name holds
a number and the run, makes it the current one. No data is renamed, and there is no moment without data: before the file
is there, readers find the version before, which is kept until the next one is published. A run that is killed leaves
files that nobody refers to; a later run removes them. Spark passes over names with an underscore in front, so a folder that was
written to plainly before stays readable as it was until the first version is published.

Adding. Rows are written to a folder below ``_pending`` and marked as complete, which settles that they count; then their
files are moved in beside the others. If that is cut short, the next run moves the rest. A name that was
added before is not added again.

Readers ask :func:`current` for the folder to read; the scans and the catalog of this library do.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

from millrace.session import hadoop_path

RUNS, PUBLISHED = "_runs", "_published"
PENDING, ADDED, COMPLETE = "_pending", "_added", "_COMPLETE"
ABANDONED = 24 * 3600  # seconds after which an unmarked pending folder is taken for that of a killed run
KEPT = 2  # versions: the current one, and the one its readers may still be reading


def names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_path(spark, path)
    fs.delete(target, True)


def touch(spark: SparkSession, path: str) -> None:
    fs, target = hadoop_path(spark, path)
    fs.mkdirs(target.getParent())
    fs.createNewFile(target)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as the catalog records it."""
    fs, target = hadoop_path(spark, path)
    return fs.makeQualified(target).toString()


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The published versions that are still there, oldest first: number and folder."""
    place = path.rstrip("/")
    marks = [name.partition(".") for name in names(spark, f"{place}/{PUBLISHED}")]
    return [(int(number), f"{place}/{RUNS}/{run}") for number, _, run in marks]


def current(spark: SparkSession, path: str) -> str:
    """The folder that holds the rows of ``path`` now: that of the last published run, or ``path`` itself."""
    if any(c in path for c in "*?[{"):
        return path
    found = versions(spark, path)
    return found[-1][1] if found else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, and only then make it the one that ``path`` stands for; returns it.

    Where two runs publish at once, the last one counts.
    """
    place = path.rstrip("/")
    started = max([n for n, _ in versions(spark, place)], default=0)
    run = f"{started:012d}-{uuid.uuid4().hex}"
    folder = f"{place}/{RUNS}/{run}"
    try:
        write(folder)
    except BaseException:
        _delete(spark, folder)
        raise
    if not exists(spark, folder):
        raise OSError(f"{folder} was removed while it was written: two later runs have been published")
    number = started
    while True:
        number += 1
        touch(spark, f"{place}/{PUBLISHED}/{number:012d}.{run}")
        last, now = versions(spark, place)[-1]
        if now == folder:
            break
        number = last
    _clean(spark, place)
    return folder


def _clean(spark: SparkSession, place: str) -> None:
    """Remove versions before the last ones, and what runs left that started before these."""
    found = versions(spark, place)
    kept, last = {folder for _, folder in found[-KEPT:]}, found[-1][0]
    for name in names(spark, f"{place}/{RUNS}"):
        if f"{place}/{RUNS}/{name}" not in kept and int(name.partition("-")[0]) < last - 1:
            _delete(spark, f"{place}/{RUNS}/{name}")
    for number, folder in found[:-KEPT]:
        _delete(spark, f"{place}/{PUBLISHED}/{number:012d}.{folder.rpartition('/')[2]}")
    if last >= KEPT:
        for name in names(spark, place):
            if name not in (RUNS, PUBLISHED):
                _delete(spark, f"{place}/{name}")  # from before the first version


def add(spark: SparkSession, path: str, write: Callable[[str], None], name: str | None = None) -> list[str] | None:
    """Let ``write`` fill a folder aside, then move its files in beside those that are there.

    Where ``write`` fails nothing is added. Returns the directories, relative to the folder, that got files; None, and
    ``write`` is not called, if ``name`` was added before.
    """
    target = current(spark, path).rstrip("/")
    recover(spark, target)
    name = name or uuid.uuid4().hex
    if exists(spark, f"{target}/{ADDED}/{name}"):
        return None
    pending = f"{target}/{PENDING}/{name}"
    _delete(spark, pending)
    try:
        write(pending)
    except BaseException:
        _delete(spark, pending)
        raise
    touch(spark, f"{pending}/{COMPLETE}")
    return _move_in(spark, target, name)


def forget(spark: SparkSession, path: str, prefix: str, keep: int = 2) -> None:
    """Drop the names of additions that begin with ``prefix`` but for the last ``keep``; older ones never come again."""
    target = current(spark, path).rstrip("/")
    found = [n for n in names(spark, f"{target}/{ADDED}") if n.startswith(prefix)]
    for name in found[: max(0, len(found) - keep)]:
        _delete(spark, f"{target}/{ADDED}/{name}")


def recover(spark: SparkSession, path: str) -> None:
    """Finish what earlier runs were adding when they were cut short, and remove what they had not completed."""
    target = current(spark, path).rstrip("/")
    for name in names(spark, f"{target}/{PENDING}"):
        pending = f"{target}/{PENDING}/{name}"
        if exists(spark, f"{pending}/{COMPLETE}"):
            _move_in(spark, target, name)
            continue
        fs, folder = hadoop_path(spark, pending)
        if fs.getFileStatus(folder).getModificationTime() < (time.time() - ABANDONED) * 1000:
            fs.delete(folder, True)


def _files(fs, folder, below: str = "") -> Iterator[tuple[str, str]]:
    """Data files as folder, relative to the start, and name."""
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith((".", "_")) and "=" not in name:
            continue
        if status.isDirectory():
            yield from _files(fs, status.getPath(), f"{below}{name}/")
        else:
            yield below, name


def _move_in(spark: SparkSession, target: str, name: str) -> list[str]:
    pending = f"{target}/{PENDING}/{name}"
    fs, folder = hadoop_path(spark, pending)
    moved = list(_files(fs, folder))
    for below, file in moved:
        (_, source), (_, place) = hadoop_path(spark, f"{pending}/{below}{file}"), hadoop_path(spark, f"{target}/{below}{file}")
        fs.mkdirs(place.getParent())
        # Another run may be finishing the same work.
        if not fs.rename(source, place) and not fs.exists(place):
            raise OSError(f"{source} could not be moved to {place}")
    touch(spark, f"{target}/{ADDED}/{name}")
    fs.delete(folder, True)
    return sorted({below.rstrip("/") for below, _ in moved})
