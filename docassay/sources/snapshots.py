"""Tables that change together: a folder of versions, and one pointer file that says which of them holds.

A change writes all its tables as a new version beside the old one and then replaces the pointer, which is one rename. Whatever fails before that leaves the
old version as it was; readers see the old tables or the new ones, never some of each. Files of a version are never changed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.lifecycle import newest, without

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def version(spark: SparkSession, path: str) -> str | None:
    """The version that holds, or None where nothing was written yet."""
    own, files = _files(spark, f"{path}/{POINTER}")
    return spark.read.text(f"{path}/{POINTER}", wholetext=True).first().value.strip() if files.exists(own) else None


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the version that holds, by name. They stay readable while others write."""
    held = version(spark, path)
    if held is None:
        raise FileNotFoundError(f"no version under {path}")
    own, files = _files(spark, f"{path}/{held}")
    return {s.getPath().getName(): spark.read.parquet(f"{path}/{held}/{s.getPath().getName()}") for s in files.listStatus(own)}


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame], since: str | None = None) -> str:
    """Writes the tables as the new version and makes it hold. ``since``: the version they were made from; if another holds by now, nothing changes and this fails."""
    new = f"v-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{new}/{name}")
    if since is not None and version(spark, path) != since:
        raise RuntimeError("another version was written meanwhile")
    draft, files = _files(spark, f"{path}/.{new}")
    out = files.create(draft, True)
    out.write(bytearray(new, "utf-8"))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else files.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    over = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(draft), files.makeQualified(_files(spark, f"{path}/{POINTER}")[0]), over)
    return new


def clean(spark: SparkSession, path: str) -> list[str]:
    """Deletes the versions that do not hold, once no reader needs them; gives their names."""
    held = version(spark, path)
    own, files = _files(spark, path)
    old = [s.getPath() for s in files.listStatus(own) if s.isDirectory() and s.getPath().getName() != held]
    for p in old:
        files.delete(p, True)
    return sorted(p.getName() for p in old)


def delete_applications(spark: SparkSession, path: str, gone: DataFrame, key: str) -> str:
    """A new version without the applications whose ``key`` is in ``gone``, and without their reviews. The tables are ``apps`` and ``reviews``."""
    held = version(spark, path)
    tables = read(spark, path)
    apps, reviews = without(tables["apps"], tables["reviews"], gone, key)
    return write(spark, path, {**tables, "apps": apps, "reviews": reviews}, since=held)


def delete_by_hash(spark: SparkSession, path: str, hashes: DataFrame) -> str:
    """Deletes the applications with a content hash in ``hashes`` (content_hash)."""
    return delete_applications(spark, path, hashes, "content_hash")


def delete_recent(spark: SparkSession, path: str, limit: int, by: str = "created_at") -> str:
    """Deletes the ``limit`` newest applications."""
    return delete_applications(spark, path, newest(read(spark, path)["apps"], by, limit), "app_id")
