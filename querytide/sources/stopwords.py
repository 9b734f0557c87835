"""The stop list as a versioned table that can be edited while a stream runs, by any number of editors.

An edit reads the newest version, writes the changed list to a folder of its own, and then claims the next number in the log
for that folder. If another editor has claimed the number first, the edit is made again on that editor's list, so no
change is lost. Readers take the newest claimed version and see a list from before or after an edit, never in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytide.errors import QuerytideError
from querytide.operators.stoplist import add_words, delete_words, normalise
from querytide.schema import STOP_WORDS
from querytide.session import no_rows
from querytide.settings import DEFAULT_STOP_WORDS
from querytide.sources.files import SharedFiles, VersionLog

# Attempts of an edit; every lost one means that some other editor's edit went through.
_ATTEMPTS = 100


def words_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    listed = list(words)
    if not listed:
        return no_rows(spark, STOP_WORDS)
    return spark.range(1).select(F.explode(F.lit(listed)).alias("word"))


def default_words(spark: SparkSession) -> DataFrame:
    """The initial list, normalised."""
    return normalise(words_table(spark, DEFAULT_STOP_WORDS))


def _log(spark: SparkSession, path: str) -> VersionLog:
    return VersionLog(spark, f"{path}/log")


def current_version(spark: SparkSession, path: str) -> int:
    """Newest version. The folder is listed again on every call, so a running stream sees edits."""
    newest = _log(spark, path).newest()
    if newest is None:
        raise QuerytideError(f"there is no stop list in {path}")
    return newest


def read_stop_words(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The list of a version, the newest unless one is given."""
    version = current_version(spark, path) if version is None else version
    folder = _log(spark, path).read(version)
    if folder is None:
        raise QuerytideError(f"version {version} of the stop list in {path} is not there, or not any more")
    return spark.read.schema(STOP_WORDS).parquet(f"{path}/words/{folder}")


def _write(words: DataFrame, path: str) -> str:
    folder = uuid.uuid4().hex
    words.write.parquet(f"{path}/words/{folder}")
    return folder


def create_stop_words(spark: SparkSession, path: str, words: DataFrame) -> None:
    folder = _write(normalise(words), path)
    if not _log(spark, path).claim(1, folder):
        SharedFiles(spark, f"{path}/words").delete(folder)
        raise QuerytideError(f"there is a stop list in {path} already")


def _edit(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame | None]) -> int:
    """Apply `change`, which gives None where nothing is to do, to the newest list; the version afterwards."""
    for _ in range(_ATTEMPTS):
        version = current_version(spark, path)
        changed = change(read_stop_words(spark, path, version))
        if changed is None:
            return version
        folder = _write(changed, path)
        if _log(spark, path).claim(version + 1, folder):
            return version + 1
        SharedFiles(spark, f"{path}/words").delete(folder)
    raise QuerytideError(f"the stop list in {path} was changed by others {_ATTEMPTS} times during one edit")


def add_stop_words(spark: SparkSession, path: str, words: DataFrame) -> int:
    """Adding words that are all known already, or blank, is a success and leaves the version as it is."""

    def change(current: DataFrame) -> DataFrame | None:
        known = normalise(words).join(current, "word", "left_anti").isEmpty()
        return None if known else add_words(current, words)

    return _edit(spark, path, change)


def delete_stop_words(spark: SparkSession, path: str, words: DataFrame) -> int:
    """Raises WordsNotFoundError, and leaves the list as it is, when no word matches."""
    return _edit(spark, path, lambda current: delete_words(current, words))


def expire_stop_words(spark: SparkSession, path: str, keep: int = 10, older_than_millis: int = 3_600_000) -> int:
    """Delete versions that are neither among the newest `keep` nor younger than given, and return how many.

    Who reads a version has it named in its plan, so the age must be longer than a batch or a query takes."""
    log, words = _log(spark, path), SharedFiles(spark, f"{path}/words")
    old = [v for v in sorted(log.versions())[:-keep] if log.age_millis(v) >= older_than_millis]
    for version in old:
        words.delete(log.read(version))
        log.forget(version)
    return len(old)
