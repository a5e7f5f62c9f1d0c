"""K3, K5: publishing in two phases. Readers see all tables of a version, or all of the one before.

A publication writes its tables into a new folder, ``versions/<number>``. Only when the last one
is there does it add a manifest, ``manifests/<number>``, a small file that appears in one rename.
The newest manifest names the current version. A job that fails half-way leaves a folder that no manifest names,
and the tables before stay readable together. Two publications at once cannot both take a
number: the later one fails. Catalog tables go the same way, as tables of a version below views.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports
from ..session import Scratch, materialize
from ..spec import DEFAULT_SPEC, FunnelSpec
from .writers import ONE_FILE, dashboard_tables, write_csv


class PublishConflict(RuntimeError):
    """Another publication has taken the version's number."""


class NothingPublished(LookupError):
    """There is no manifest yet."""


@dataclass(frozen=True)
class Manifest:
    version: int
    fmt: str
    tables: dict[str, str]      # name -> path below the root


class _Folder:
    """A folder of the file system that the path belongs to."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        found = self.fs.open(self.path(name))
        try:
            return bytes(found.readAllBytes()).decode()
        finally:
            found.close()


def _versions(folder: _Folder) -> list[int]:
    return sorted(int(n) for n in folder.names("manifests") if n.isdigit())


def current_manifest(spark: SparkSession, root: str) -> Manifest:
    folder = _Folder(spark, root)
    found = _versions(folder)
    if not found:
        raise NothingPublished(f"{root}: nothing has been published")
    return Manifest(**json.loads(folder.read(f"manifests/{found[-1]:012d}")))


def _switch(folder: _Folder, manifest: Manifest) -> None:
    name = f"manifests/{manifest.version:012d}"
    waiting = f"{name}.new"
    folder.fs.mkdirs(folder.path("manifests"))
    folder.write(waiting, json.dumps(vars(manifest)))
    if folder.fs.exists(folder.path(name)) or not folder.fs.rename(folder.path(waiting), folder.path(name)):
        raise PublishConflict(f"{folder.root}: version {manifest.version} is there already")


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", keep: int = 2,
            single_file: tuple[str, ...] = (), before_switch: Callable[[Manifest], None] | None = None) -> Manifest:
    """Writes all ``tables`` as a new version of ``root``, then makes it the current one.

    ``keep`` versions stay, so that readers of the one before can finish; older ones and what failed
    publications left below their numbers go. ``before_switch`` may check the written tables, and raise.
    """
    if keep < 1:
        raise ValueError("the current version has to be kept")
    folder = _Folder(spark, root)
    numbers = [*_versions(folder), *(int(n) for n in folder.names("versions") if n.isdigit())]
    version = max(numbers, default=0) + 1
    manifest = Manifest(version, fmt, {name: f"versions/{version:012d}/{name}" for name in tables})
    for name, df in tables.items():
        path = f"{folder.root}/{manifest.tables[name]}"
        if fmt == "csv":
            write_csv(df, path, single_file=name in single_file)
        else:
            df.write.mode("errorifexists").format(fmt).save(path)
    if before_switch is not None:
        before_switch(manifest)
    _switch(folder, manifest)
    kept = _versions(folder)[-keep:]
    for n in folder.names("versions"):
        if n.isdigit() and int(n) < kept[0]:
            folder.fs.delete(folder.path(f"versions/{n}"), True)
    for n in folder.names("manifests"):
        if n.isdigit() and int(n) < kept[0]:
            folder.fs.delete(folder.path(f"manifests/{n}"), False)
    return manifest


def read_published(spark: SparkSession, root: str, name: str, manifest: Manifest | None = None) -> DataFrame:
    """A table of the current version; with ``manifest``, of that one, so that several tables fit together."""
    manifest = manifest or current_manifest(spark, root)
    reader = spark.read.option("header", True).option("inferSchema", True) if manifest.fmt == "csv" else spark.read
    return reader.format(manifest.fmt).load(f"{root.rstrip('/')}/{manifest.tables[name]}")


def publish_extracts(spark: SparkSession, sessions: DataFrame, purchases: DataFrame, root: str, fmt: str = "csv",
                     spec: FunnelSpec = DEFAULT_SPEC, keep: int = 2) -> Manifest:
    """K5: the six dashboard tables of one metric cube, all or none."""
    with Scratch(spark) as scratch:
        cube = materialize(reports.metric_cube(sessions, spec), "metric-cube", scratch)
        return publish(spark, dashboard_tables(cube, purchases, spec), root, fmt, keep, single_file=ONE_FILE)


def publish_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], database: str, version: int) -> dict[str, str]:
    """K3: ``<name>__v<version>`` for every table, then a view ``<name>`` on each: views move only when all tables are written."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = {name: f"{database}.{name}__v{version}" for name in tables}
    for name, df in tables.items():
        df.write.mode("overwrite").format("parquet").saveAsTable(names[name])
    for name, table in names.items():
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * FROM {table}")
    return names
