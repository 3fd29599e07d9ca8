"""Tables written once to the folder that the driver and all executors share, and read from there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, on a local master only, a temporary folder. Inside ``spooling_in`` the
    folder that was given."""
    if (own := getattr(_scopes, "folder", None)) is not None:
        return own
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lumberline-")
        context.setCheckpointDir(folder)
    return folder


def spooled(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder: its plan is computed once, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    remembered(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_file(df: DataFrame) -> str:
    """The path of ``df`` (value) as text in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    remembered(spark, path)
    df.write.text(path)
    return path


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    remembered(spark, path)
    return path


def local_copy(folder: str, path: str) -> str:
    """The only text file of a written folder, moved to ``path``: its place for those who open it as a file."""
    spark = next(s for s, p in _written if p == folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(folder), hadoop.Path(path)
    system = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    found = next(s.getPath() for s in system.listStatus(source) if s.getPath().getName().startswith("part-"))
    system.delete(target, False)
    if not system.rename(found, target):
        raise OSError(f"{folder} can't be moved to {path}")
    return target.toUri().getPath()


def remembered(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver ends, if it isn't released before."""
    if not _written:
        atexit.register(release_all)
    _written.append((spark, path))
    if (own := getattr(_scopes, "paths", None)) is not None:
        own.append(path)


@contextlib.contextmanager
def undone_if_failed() -> Iterator[None]:
    """What this thread writes inside is deleted if it ends with an error, unless that was released before."""
    outer, own = getattr(_scopes, "paths", None), []
    _scopes.paths = own
    try:
        yield
    except BaseException:
        for entry in [e for e in _written if e[1] in own]:
            _written.remove(entry)
            _delete(*entry)
        own.clear()
        raise
    finally:
        _scopes.paths = outer
        if outer is not None:
            outer += own


@contextlib.contextmanager
def spooling_in(folder: str) -> Iterator[None]:
    """What this thread writes inside goes to a folder of the caller's, which all executors must see."""
    outer = getattr(_scopes, "folder", None)
    _scopes.folder = folder
    try:
        yield
    finally:
        _scopes.folder = outer


def kept(paths: list[str]) -> None:
    """These folders stay when the driver ends, and what is released doesn't include them."""
    names = {p.rsplit("/", 1)[-1] for p in paths}
    _written[:] = [e for e in _written if e[1].rsplit("/", 1)[-1] not in names]


def release(df: DataFrame) -> None:
    """Delete the spooled tables that ``df`` reads."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for entry in [e for e in _written if e[1].rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]]:
            _written.remove(entry)
            _delete(*entry)


def release_all() -> None:
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session may have ended before
            return


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
