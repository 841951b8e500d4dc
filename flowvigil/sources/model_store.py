"""Model store: suites of fitted models in versions, and the suite that is active.

A model is kept as rows: the nodes of trees in one Parquet table, all other parameters (scalers, centres, weights,
names, thresholds) as cells in another, both partitioned by suite and version. So models can be queried,
compared and counted like data, and read in any session. Spark's own models and lookup tables (category codes) are
written by their own writers beside them.

A version can be seen only once its manifest is written, which is the last step; its number is claimed by
creating a file that must not exist yet, so that writers at the same time get different ones. The active suite is the last
record of a log whose entries are claimed in the same way: a switch is one new file, readers see the old or the new suite.

root/
    claims/<suite>-<version>      number taken
    nodes/suite=/version=         trees as rows
    cells/suite=/version=         parameters as rows
    parts/<suite>/<version>/      Spark models and tables
    versions/<suite>-<version>    manifest
    active/<number>               switches, in order
"""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Mapping
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowvigil.operators.boosting import BoostedTreesModel
from flowvigil.operators.curved import CurvedAutoencoder
from flowvigil.operators.forest import RandomForestModel
from flowvigil.operators.isolation import IsolationForest
from flowvigil.operators.kmeans import KMeansDetector
from flowvigil.operators.reconstruction import LinearAutoencoder, SequenceModel
from flowvigil.sources.folders import Folders

CLASSES = {c.__name__: c for c in (IsolationForest, KMeansDetector, LinearAutoencoder, CurvedAutoencoder, SequenceModel, RandomForestModel, BoostedTreesModel)}
NODES = "part string, field string, tree int, node int, feature int, cut double, low int, high int, path double"
CELLS = "part string, field string, kind string, shape array<int>, pos int, number double, text string"
VERSIONS = "suite string, version int, parts map<string,string>, metadata string, saved_at timestamp"
ACTIVE = "seq long, suite string, version int"
_TREE = {"feature": pa.int32(), "cut": pa.float64(), "low": pa.int32(), "high": pa.int32(), "path": pa.float64()}
_NAME = re.compile(r"[A-Za-z0-9_]+")


def _is_trees(value) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], Mapping) and set(value[0]) == set(_TREE)


def _is_scaler(value) -> bool:
    return isinstance(value, Mapping) and all(isinstance(k, str) and len(v) == 2 for k, v in value.items())


def _cells(value) -> tuple[str, list[int], list[tuple[float | None, str | None]]]:
    """(kind, shape, [(number, text)]) of a parameter."""
    if value is None:
        return "none", [], []
    if isinstance(value, (bool, np.bool_)):
        return "bool", [], [(float(value), None)]
    if isinstance(value, (int, np.integer)):
        return "int", [], [(None, str(int(value)))]
    if isinstance(value, (float, np.floating)):
        return "float", [], [(float(value), None)]
    if isinstance(value, str):
        return "text", [], [(None, value)]
    if _is_scaler(value):
        return "scaler", [len(value), 2], [(float(x), column) for column, pair in value.items() for x in pair]
    if isinstance(value, np.ndarray):
        return "array", list(value.shape), [(float(x), None) for x in value.ravel()]
    if isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value):
        return "texts", [len(value)], [(None, x) for x in value]
    if isinstance(value, (list, tuple)):
        numbers = np.array(value, float)
        return "list", list(numbers.shape), [(float(x), None) for x in numbers.ravel()]
    raise TypeError(f"cannot keep a {type(value).__name__}")


def _value(kind: str, shape: list[int], cells: list[tuple[float | None, str | None]]):
    if kind == "none":
        return None
    if kind == "scaler":
        return {cells[i][1]: (cells[i][0], cells[i + 1][0]) for i in range(0, len(cells), 2)}
    if kind == "texts":
        return [text for _, text in cells]
    if kind in ("array", "list"):
        numbers = np.array([number for number, _ in cells], float).reshape(shape)
        return numbers if kind == "array" else numbers.tolist()
    number, text = cells[0]
    return {"bool": bool, "int": int, "float": float, "text": str}[kind](text if kind in ("int", "text") else number)


class ModelStore:
    """Suites under ``root``. Parts of a suite are detectors (CLASSES), Spark models, DataFrames (lookup tables),
    scalers or baselines ``{column: (mean, deviation)}``, arrays, numbers, texts and lists of them.

    Parameters are of bounded size and go through the driver; tables do not.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folders = spark, root.rstrip("/"), Folders(spark)

    # --- writing ---

    def save(self, suite: str, parts: Mapping[str, object], **metadata) -> int:
        """Keep ``parts`` as the next version of ``suite`` and return its number."""
        for name in (suite, *parts):
            if not _NAME.fullmatch(name):
                raise ValueError(f"{name!r}: names have letters, digits and _ only")
        version = self._claim(suite)
        kinds, cells, nodes = {}, [], []
        for part, value in parts.items():
            kinds[part] = type(value).__name__ if type(value).__name__ in CLASSES else ""
            # of a dataclass each field, of anything else the value itself
            fields = {f.name: getattr(value, f.name) for f in dataclasses.fields(value)} if kinds[part] else {"": value}
            for field, content in fields.items():
                beside = f"{self.root}/parts/{suite}/{version}/{part}-{field}"
                if isinstance(content, DataFrame):
                    content.write.parquet(beside)
                    cells.append((part, field, "table", [], None, None, None))
                elif isinstance(content, Model):
                    PipelineModel([content]).save(beside)
                    cells.append((part, field, "spark", [], None, None, None))
                elif _is_trees(content):
                    nodes.append(_node_table(part, field, content))
                else:
                    kind, shape, found = _cells(content)
                    rows = [(part, field, kind, shape, i, *cell) for i, cell in enumerate(found)]
                    cells += rows or [(part, field, kind, shape, None, None, None)]
        self._put("cells", suite, version, self.spark.createDataFrame(cells, CELLS))
        if nodes:
            self._put("nodes", suite, version, self.spark.createDataFrame(pa.concat_tables(nodes)))
        manifest = {"suite": suite, "version": version, "parts": kinds, "metadata": json.dumps(metadata, sort_keys=True),
                    "saved_at": datetime.now(timezone.utc).isoformat()}
        self.folders.create_new(f"{self.root}/versions/{suite}-{version}", json.dumps(manifest))
        return version

    def _claim(self, suite: str) -> int:
        taken = [int(e.name.rsplit("-", 1)[1]) for e in self.folders.matching(f"{self.root}/claims/{suite}-*")]
        version = max(taken, default=0) + 1
        while not self.folders.create_new(f"{self.root}/claims/{suite}-{version}", suite):
            version += 1
        return version

    def _put(self, table: str, suite: str, version: int, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{table}/suite={suite}/version={version}")

    # --- the tables ---

    def versions(self) -> DataFrame:
        """Every whole version: suite, version, parts, metadata, saved_at."""
        return self._json("versions", VERSIONS).where(F.col("suite").isNotNull())

    def _json(self, folder: str, schema: str) -> DataFrame:
        path = f"{self.root}/{folder}"
        return self.spark.read.schema(schema).json(path) if self.folders.exists(path) else self.spark.createDataFrame([], schema)

    def _rows(self, table: str, schema: str) -> DataFrame:
        schema += ", suite string, version int"
        if not self.folders.matching(f"{self.root}/{table}/suite=*"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        return rows.join(F.broadcast(self.versions().select("suite", "version")), ["suite", "version"], "left_semi")  # one row a version

    def nodes(self) -> DataFrame:
        """The nodes of all trees of all whole versions."""
        return self._rows("nodes", NODES)

    def cells(self) -> DataFrame:
        """The other parameters of all whole versions, a row a number or text."""
        return self._rows("cells", CELLS)

    # --- reading ---

    def latest(self, suite: str) -> int:
        version = self.versions().where(F.col("suite") == suite).agg(F.max("version")).first()[0]
        if version is None:
            raise LookupError(f"no version of suite {suite!r}")
        return version

    def load(self, suite: str, version: int | None = None) -> dict[str, object]:
        """The parts of a version, the newest by default."""
        version = self.latest(suite) if version is None else version
        listed = self.versions().where((F.col("suite") == suite) & (F.col("version") == version)).first()
        if listed is None:
            raise LookupError(f"no version {version} of suite {suite!r}")
        own = (F.col("suite") == suite) & (F.col("version") == version)
        fields: dict[tuple[str, str], object] = {}
        found: dict[tuple[str, str], tuple[str, list[int], list]] = {}
        for row in self.cells().where(own).orderBy("part", "field", "pos").collect():
            beside = f"{self.root}/parts/{suite}/{version}/{row['part']}-{row['field']}"
            at = (row["part"], row["field"])
            if row["kind"] == "table":
                fields[at] = self.spark.read.parquet(beside)
            elif row["kind"] == "spark":
                fields[at] = PipelineModel.load(beside).stages[0]
            else:
                cells = found.setdefault(at, (row["kind"], row["shape"], []))[2]
                if row["pos"] is not None:
                    cells.append((row["number"], row["text"]))
        fields |= {at: _value(*cells) for at, cells in found.items()}
        trees = self.nodes().where(own).orderBy("part", "field", "tree", "node").toPandas()
        for at, rows in trees.groupby(["part", "field"]):
            fields[at] = [{c: tree[c].to_numpy() for c in _TREE} for _, tree in rows.groupby("tree")]
        parts = {}
        for part, kind in listed["parts"].items():
            own_fields = {field: value for (p, field), value in fields.items() if p == part}
            parts[part] = CLASSES[kind](**own_fields) if kind else own_fields[""]
        return parts

    # --- the active suite ---

    def activate(self, suite: str, version: int | None = None) -> int:
        """Make a version (the newest by default) the active one; its number. The last of several switches at once wins."""
        version = self.latest(suite) if version is None else version
        if self.versions().where((F.col("suite") == suite) & (F.col("version") == version)).isEmpty():
            raise LookupError(f"no version {version} of suite {suite!r}")
        number = max((int(e.name) for e in self.folders.matching(f"{self.root}/active/[0-9]*")), default=0) + 1
        while not self.folders.create_new(f"{self.root}/active/{number:012d}", json.dumps({"seq": number, "suite": suite, "version": version})):
            number += 1
        return version

    def active(self) -> tuple[str, int] | None:
        """(suite, version) of the last whole switch, or None."""
        row = self.switches().orderBy(F.col("seq").desc()).first()
        return (row["suite"], row["version"]) if row else None

    def switches(self) -> DataFrame:
        return self._json("active", ACTIVE).where(F.col("suite").isNotNull() & F.col("version").isNotNull())

    def load_active(self) -> dict[str, object]:
        """The parts of the active version; none when nothing was activated (safe mode)."""
        now = self.active()
        return self.load(*now) if now else {}

    # --- keeping few ---

    def prune(self, suite: str, keep: int = 10) -> list[int]:
        """Remove all but the newest ``keep`` versions of a suite; the active one stays. The numbers removed.

        The manifest goes first, so a version is never seen in part, and a repeated call finishes what one left.
        """
        listed = {r["version"] for r in self.versions().where(F.col("suite") == suite).select("version").collect()}
        written = {int(e.name.rsplit("-", 1)[1]) for e in self.folders.matching(f"{self.root}/claims/{suite}-*")}
        now = self.active()
        stay = set(sorted(listed)[-keep:] if keep else []) | ({now[1]} if now and now[0] == suite else set())
        # a claimed number above the newest version may be in writing
        gone = sorted(v for v in written | listed if v not in stay and v < max(listed, default=0))
        for version in gone:
            self.folders.delete(f"{self.root}/versions/{suite}-{version}")
            for path in (f"nodes/suite={suite}/version={version}", f"cells/suite={suite}/version={version}", f"parts/{suite}/{version}"):
                self.folders.delete(f"{self.root}/{path}")
        return [v for v in gone if v in listed]


def _node_table(part: str, field: str, trees: list[Mapping[str, np.ndarray]]) -> pa.Table:
    sizes = [len(tree["feature"]) for tree in trees]
    columns = {"part": pa.array([part] * sum(sizes)), "field": pa.array([field] * sum(sizes)),
               "tree": pa.array(np.repeat(np.arange(len(trees)), sizes), pa.int32()),
               "node": pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32())}
    columns |= {name: pa.array(np.concatenate([np.asarray(tree[name]) for tree in trees]).astype(kind.to_pandas_dtype()), kind)
                for name, kind in _TREE.items()}
    return pa.table(columns)
