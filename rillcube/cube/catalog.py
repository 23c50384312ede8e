"""Cubes at rest: folders of partial states, and a manifest that says which of them are the cube.

An insert writes the new rows' partial states into a folder of their own and then puts out the next manifest, which
names all folders that count.  A manifest is written whole under another name and renamed to its number, which fails if
that number is taken; so it is seen as a whole or not at all, and of two writers one starts over from the other's.  Folders
that no manifest names are no part of the cube, so a writer that is lost at any point changes nothing.

A batch is known by its stream and number (or name).  Writing it again replaces it; once ``compact`` has folded it, its
name stays in the manifest (numbers as ranges) and writing it again changes nothing.  ``compact`` folds all folders into one.  It removes
only what the compaction before it had replaced, so tables read in between stay whole.

No insert rewrites what is there: the cost of an insert is the size of the insert and of the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillcube.cube.cube import Cube
from rillcube.cube.spec import Aggregate, CubeSpec, Dimension, is_name
from rillcube.schema import EngineSchemaError

_EMPTY = {"parts": [], "folded": {}, "names": [], "retired": [], "rollups": {}}
_KEPT_MANIFESTS = 10
_TRIES = 50


def _with_number(ranges: list[list[int]], n: int) -> list[list[int]]:
    """Sorted ranges, both ends included, with ``n`` among them."""
    out: list[list[int]] = []
    for low, high in sorted([*ranges, [n, n]]):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


class CubeCatalog:
    """The cubes under a folder that all executors share; another process that opens the folder finds them again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._specs: dict[str, CubeSpec] = {}

    # files

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, name: str) -> str:
        if not is_name(name):
            raise EngineSchemaError(f"{name!r} is no name for a cube")
        return f"{self.root}/{name}"

    def _read(self, path: str) -> str:
        stream = self._fs().open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> bool:
        """Write a file in one step; False if there is one of that name."""
        fs, draft = self._fs(), self._path(f"{path.rpartition('/')[0]}/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(draft, self._path(path), gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Exception:
            fs.delete(draft, False)
            if fs.exists(self._path(path)):
                return False
            raise
        return True

    def _listed(self, path: str) -> list[str]:
        fs, folder = self._fs(), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _manifests(self, name: str) -> list[int]:
        return [int(f) for f in self._listed(f"{self._folder(name)}/manifest") if f.isdigit()]

    def _manifest(self, name: str) -> tuple[int, dict]:
        """The number and contents of the manifest in force."""
        found = self._manifests(name)
        return (found[-1], json.loads(self._read(f"{self._folder(name)}/manifest/{found[-1]:012d}"))) if found else (0, dict(_EMPTY))

    def _commit(self, name: str, change) -> dict:
        """The next manifest: ``change`` of the one in force, again from the start if another writer was first."""
        for _ in range(_TRIES):
            number, now = self._manifest(name)
            after = change(now)
            if after is now or self._put(f"{self._folder(name)}/manifest/{number + 1:012d}", json.dumps(after)):
                return after
        raise EngineSchemaError(f"cube {name} is written by too many at once")

    # cubes

    def create(self, spec: CubeSpec, overwrite: bool = False) -> CubeSpec:
        """The existing spec of that name if there is one; ``overwrite`` clears its contents."""
        if overwrite:
            self.destroy(spec.name)
        self._put(f"{self._folder(spec.name)}/spec.json", json.dumps(asdict(spec)))
        return self.spec(spec.name)

    def spec(self, name: str) -> CubeSpec:
        if name not in self._specs:
            path = f"{self._folder(name)}/spec.json"
            if not self._fs().exists(self._path(path)):
                raise EngineSchemaError(f"there is no cube {name}")
            read = json.loads(self._read(path))
            aggs = [Aggregate(**{**a, "columns": tuple(a["columns"])}) for a in read["aggs"]]
            self._specs[name] = CubeSpec(read["name"], [Dimension(**d) for d in read["dims"]], aggs, read["version"])
        return self._specs[name]

    def clear(self, name: str) -> None:
        """Nothing in the cube any more; its spec stays."""
        for part in ("manifest", "data"):
            self._fs().delete(self._path(f"{self._folder(name)}/{part}"), True)

    def destroy(self, name: str) -> None:
        self._fs().delete(self._path(self._folder(name)), True)
        self._specs.pop(name, None)

    def names(self) -> list[str]:
        fs, start = self._fs(), len(self._fs().makeQualified(self._path(self.root)).toString()) + 1
        found = [s.getPath().getParent().toString()[start:] for depth in ("*", "*/*") for s in fs.globStatus(self._path(f"{self.root}/{depth}/spec.json")) or []]
        return sorted(found)

    def batches(self, name: str) -> list[str]:
        """The parts of which the cube is read, by the names of their batches; what was folded is one part."""
        return [p["batch"] for p in self._manifest(name)[1]["parts"]]

    @staticmethod
    def _folded(manifest: dict, stream: str, batch: str | int | None) -> bool:
        if isinstance(batch, int):
            return any(low <= batch <= high for low, high in manifest["folded"].get(stream, []))
        return batch is not None and [stream, batch] in manifest["names"]

    def insert(self, name: str, df: DataFrame, batch: str | int | None = None, stream: str = "") -> None:
        """The rows of ``df`` as one batch; a batch without a name is a new one each time.  Batches of different streams are different."""
        spec = self.spec(name)
        if self._folded(self._manifest(name)[1], stream, batch):
            return
        kept = f"data/{uuid.uuid4().hex}"
        Cube.build(spec, df).cells.write.parquet(f"{self._folder(name)}/{kept}")
        part = {"batch": f"{stream}#{kept[5:] if batch is None else batch}", "stream": stream, "id": batch, "folder": kept}

        def change(now: dict) -> dict:
            if self._folded(now, stream, batch):
                return now
            same = [p for p in now["parts"] if batch is not None and (p["stream"], p["id"]) == (stream, batch)]
            return {**now, "parts": [p for p in now["parts"] if p not in same] + [part], "retired": now["retired"] + [p["folder"] for p in same]}

        self._commit(name, change)

    def get(self, name: str) -> Cube:
        """The cube as of now; raises if nothing was ever inserted."""
        spec, found = self.spec(name), self._manifest(name)[1]["parts"]
        if not found:
            raise EngineSchemaError(f"cube {name} holds nothing yet")
        parts = self.spark.read.parquet(*[f"{self._folder(name)}/{p['folder']}" for p in found])
        if len(found) == 1:
            return Cube(spec, parts)
        return Cube.merge(Cube(spec, parts))

    def compact(self, name: str) -> None:
        """All parts into one.  What this replaces stays on disk until the next compaction; what the one before replaced goes."""
        number, now = self._manifest(name)
        parts, old = now["parts"], now["retired"]
        if len(parts) > 1:
            kept = f"data/{uuid.uuid4().hex}"
            self.get(name).cells.write.parquet(f"{self._folder(name)}/{kept}")

            def change(latest: dict) -> dict:
                if any(p not in latest["parts"] for p in parts):  # folded or replaced by another writer meanwhile
                    return latest
                folded, names = dict(latest["folded"]), list(latest["names"])
                for p in parts:
                    if isinstance(p["id"], int):
                        folded[p["stream"]] = _with_number(folded.get(p["stream"], []), p["id"])
                    elif p["id"] is not None:
                        names.append([p["stream"], p["id"]])
                one = {"batch": f"#{kept[5:]}", "stream": "", "id": None, "folder": kept}
                gone = [f for f in latest["retired"] if f not in old] + [p["folder"] for p in parts]
                return {**latest, "parts": [one] + [p for p in latest["parts"] if p not in parts], "folded": folded, "names": names, "retired": gone}

            if kept not in [p["folder"] for p in self._commit(name, change)["parts"]]:
                old = [kept]
            for folder in old:
                self._fs().delete(self._path(f"{self._folder(name)}/{folder}"), True)
            for past in self._manifests(name)[:-_KEPT_MANIFESTS]:
                self._fs().delete(self._path(f"{self._folder(name)}/manifest/{past:012d}"), False)

    def _vector(self, name: str, levels: Mapping[str, int]) -> dict[str, int]:
        spec = self.spec(name)
        for dim in levels:
            spec.dim(dim)
        return {d.name: min(levels.get(d.name, d.leaf), d.leaf) for d in spec.dims}

    def store_rollup(self, name: str, levels: Mapping[str, int]) -> None:
        """The cube's cells at a vector of levels, as of now, kept beside it as partial states; takes the place of the one stored before."""
        vector, kept = self._vector(name, levels), f"data/{uuid.uuid4().hex}"
        self.get(name).levels_of(vector).write.parquet(f"{self._folder(name)}/{kept}")
        key = json.dumps(vector)

        def change(now: dict) -> dict:
            before = [now["rollups"][key]] if key in now["rollups"] else []
            return {**now, "rollups": {**now["rollups"], key: kept}, "retired": now["retired"] + before}

        self._commit(name, change)

    def stored_rollup(self, name: str, levels: Mapping[str, int]) -> Cube:
        """The stored cells at exactly these levels, to slice and finish; raises if none are stored."""
        vector = self._vector(name, levels)
        folder = self._manifest(name)[1]["rollups"].get(json.dumps(vector))
        if folder is None:
            raise EngineSchemaError(f"cube {name} has no stored rollup at {vector}")
        cells = self.spark.read.parquet(f"{self._folder(name)}/{folder}")
        return Cube(self.spec(name), cells.drop(*[f"{d}_level" for d in vector]))

    def insert_stream(self, name: str, stream: DataFrame, checkpoint: str, label: str = "") -> StreamingQuery:
        """A stream into the cube; a batch that is run again replaces itself, or changes nothing once it is folded.  Each stream into one cube has its own ``label``."""
        return stream.writeStream.foreachBatch(lambda df, n: self.insert(name, df, int(n), label)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
