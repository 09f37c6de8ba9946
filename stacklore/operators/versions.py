"""Tables that change together: a version is published whole, or not at all.

A store is a folder. Every publish writes a new layer, the rows that come in and the keys
whose older rows they replace, to folders of its own; then it names the layer in a new
manifest, which appears under its number in one rename. Until then nobody sees the layer,
and a job that dies leaves files that no manifest names. A manifest says which layers a
version has, so readers of an older version go on reading it. Whoever publishes says
which version the work began from; if another was faster, the publish is refused.

A draft is a layer that no manifest names yet: what a job works out once is written there,
read by the rest of the job, and published where it lies. Keys that turn out to be no good
are named with the layer, and nobody reads their rows.

Reading takes each layer's rows but those whose keys a later layer replaces (an anti-join,
on keys only). Compaction writes the rows of all layers as one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _folder

#: layers of a version before publish folds them into one
MOST_LAYERS = 8


class Conflict(RuntimeError):
    """Another writer has published since."""


@dataclass
class Draft:
    """Tables of a layer to come."""

    store: Store
    layer: str = field(default_factory=lambda: uuid.uuid4().hex)
    schemas: dict[str, str] = field(default_factory=dict)

    def put(self, name: str, rows: DataFrame, deal: bool = False, split: bool = True) -> DataFrame:
        """Add rows to a table of the layer; all that the table holds then, with their columns.

        deal brings the rows of a partition to one task, which else each task writes a file of; split
        says that the table has partitions at all.
        """
        part = self.store.partition if split and self.store.partition in rows.columns else None
        if part and deal:
            rows = rows.repartition(part)
        writer = rows.write.mode("append").option("compression", "zstd")
        (writer.partitionBy(part) if part else writer).parquet(self.store._at(self.layer, name))
        self.schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return self.store.spark.read.schema(self.schemas[name]).parquet(self.store._at(self.layer, name))

    def done(self, gone: DataFrame | None, void: DataFrame | None = None) -> dict:
        """What a manifest says of the layer."""
        for name, keys in (("_gone", gone), ("_void", void)):
            if keys is not None:
                keys.select(self.store.key).where(F.col(self.store.key).isNotNull()).distinct().write.parquet(self.store._at(self.layer, name))
        return {"id": self.layer, "tables": {n: {"schema": s} for n, s in self.schemas.items()}, "gone": gone is not None, "void": void is not None}


@dataclass
class Store:
    """Tables below path, all keyed by one column."""

    spark: SparkSession
    path: str
    key: str = "doc_id"
    partition: str | None = None

    def version(self) -> int:
        """The newest version; 0 for a store without any."""
        system, folder = _folder(self.spark, f"{self.path}/_versions")
        if not system.exists(folder):
            return 0
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("_")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "layers": [], "stamps": {}}
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/_versions/{version:010d}.json", wholetext=True).collect())
        return json.loads(text)

    def stamps(self, version: int | None = None) -> dict:
        """What the tables were built with."""
        return self.manifest(version)["stamps"]

    def tables(self, version: int | None = None) -> list[str]:
        return sorted({t for layer in self.manifest(version)["layers"] for t in layer["tables"]})

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of one table in a version (the newest)."""
        layers = [x for x in self.manifest(version)["layers"] if name in x["tables"]]
        if not layers:
            raise ValueError(f"no version has a table {name}")
        parts, replaced = [], None
        for layer in reversed(layers):
            rows = self.spark.read.schema(layer["tables"][name]["schema"]).parquet(self._at(layer["id"], name))
            void = self.spark.read.parquet(self._at(layer["id"], "_void")) if layer.get("void") else None
            if void is not None:
                rows = rows.where(F.col(self.key).isNotNull())
            hidden = replaced if void is None else void if replaced is None else replaced.unionByName(void)
            parts.append(rows if hidden is None else rows.join(hidden, self.key, "left_anti"))
            if layer["gone"]:
                gone = self.spark.read.parquet(self._at(layer["id"], "_gone"))
                replaced = gone if replaced is None else replaced.unionByName(gone)
        columns = parts[0].columns
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*columns)

    def draft(self) -> Draft:
        return Draft(self)

    def publish(
        self, tables: dict[str, DataFrame] | Draft, gone: DataFrame | None = None, expected: int | None = None, stamps: dict | None = None, void: DataFrame | None = None
    ) -> int:
        """Put rows into tables, in place of all older rows there of the keys in gone; the new version's number.

        gone holds the key column; null keys replace nothing. Without it rows are added.
        expected is the version that the work began from (now, if not given). Tables that are not
        named stay as they are. The same rows published again for the same keys change nothing
        that a reader sees. tables may be a draft; then void holds keys that are no good: its rows of
        these, and of null keys, are not read.
        """
        begun = self.version() if expected is None else expected
        before = self.manifest(begun)
        layer = tables.done(gone, void) if isinstance(tables, Draft) else self._write(tables, gone)
        layers = [*before["layers"], layer]
        self._name(begun + 1, {"version": begun + 1, "layers": layers, "stamps": before["stamps"] | (stamps or {})})
        if len(layers) > MOST_LAYERS:
            return self.compact()
        return begun + 1

    def compact(self) -> int:
        """The newest version with all its layers as one, as a new version."""
        begun = self.version()
        before = self.manifest(begun)
        layer = self._write({t: self.read(t, begun) for t in self.tables(begun)}, None)
        return self._name(begun + 1, before | {"version": begun + 1, "layers": [layer]})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove versions but the newest few, and layers that no version names any more; the names of these layers.

        To be called when nobody publishes: a layer that is being written is named by none yet.
        """
        newest = self.version()
        system, folder = _folder(self.spark, f"{self.path}/_versions")
        used: set[str] = set()
        for version in range(1, newest + 1):
            _, file = _folder(self.spark, f"{self.path}/_versions/{version:010d}.json")
            if version <= newest - keep:
                system.delete(file, True)
            elif system.exists(file):
                used |= {x["id"] for x in self.manifest(version)["layers"]}
        system, folder = _folder(self.spark, f"{self.path}/layers")
        found = [f.getPath() for f in system.listStatus(folder)] if system.exists(folder) else []
        unused = [f for f in found if f.getName() not in used]
        for file in unused:
            system.delete(file, True)
        return sorted(f.getName() for f in unused)

    def _at(self, layer: str, name: str) -> str:
        return f"{self.path}/layers/{layer}/{name}"

    def _write(self, tables: dict[str, DataFrame], gone: DataFrame | None) -> dict:
        draft = self.draft()
        for name, rows in tables.items():
            draft.put(name, rows)
        return draft.done(gone)

    def _name(self, version: int, manifest: dict) -> int:
        """Let the manifest appear under its number, unless there is one already."""
        jvm = self.spark._jvm
        system, target = _folder(self.spark, f"{self.path}/_versions/{version:010d}.json")
        _, draft = _folder(self.spark, f"{self.path}/_drafts/{uuid.uuid4().hex}.json")
        system.mkdirs(target.getParent())
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, none)
        except Exception as error:
            system.delete(draft, False)
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"version {version} is there already") from None
            raise
        return version
