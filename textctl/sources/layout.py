"""The benchmark's folder layout as a Spark data source.

    {root}/{task}/prompts_v{version}.jsonl                               master
    {root}/{task}/{model}/generated_result/generated_result_v{version}.jsonl         results
    {root}/{task}/{model}/generated_result/generated_result_v{version}_wo_hf.jsonl   results_clean
    {root}/{task}/{model}/score/v{version}_ctg_score_{iter}.txt          ctg_report
    {root}/{task}/{model}/score/v{version}_quality_score.txt             quality_report

``register(spark)``, then ``spark.read.format("textctl_layout").option("kind",
"results").load(root)``. ``task``, ``model`` and ``iter`` are columns taken
from the path. Conditions on ``task`` and ``model`` are pushed down: folders
that they rule out are not listed. Large JSON lines files are cut into ranges
of ``split_bytes``; a line belongs to the range it starts in. A line that
does not parse is kept in ``_corrupt_record``. The kind ``models`` gives the
(task, model) folders with results, without opening a file.

Writing takes two phases. Tasks write into a staging folder; the commit
writes one file that lists every move (and with mode ``overwrite`` the
replaced files of the folders that get rows, and of no others) and then
makes the moves. Before that file exists nothing is visible; once it does,
readers see the whole write, even if the moves are interrupted, and the next
writer finishes them. Failed attempts leave nothing. A text report's lines
must reach one task in ``line_no`` order (``write`` sees to it); the writer
refuses a report split over tasks.

Files are opened through ``pyarrow.fs`` (local paths and the URIs it knows),
by the tasks that read or write them; the driver lists folders and holds one
name per file.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ..schemas import MASTER, RESULTS_CLEAN_WIDE, RESULTS_WIDE

NAME = "textctl_layout"
_PATH = {c: T.StructField(c, T.IntegerType() if c == "iter" else T.StringType()) for c in ("task", "model", "iter")}
_LINES = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])
_RESULTS = r"generated_result_v(?P<version>[^_/-]+)"


@dataclass(frozen=True)
class Kind:
    path: tuple[str, ...]
    folder: str
    pattern: str
    name: str
    fields: T.StructType
    lines: bool = False

    def schema(self) -> T.StructType:
        own = [f for f in self.fields if f.name not in self.path]
        bad = [] if self.lines or not own else [T.StructField("_corrupt_record", T.StringType())]
        return T.StructType([_PATH[c] for c in self.path] + own + bad)


def _renamed(schema: T.StructType) -> T.StructType:
    """The model field of a results file is the model's path."""
    return T.StructType([T.StructField("model_path" if f.name == "model" else f.name, f.dataType) for f in schema])


# The layout's folders and file names.
KINDS = {
    "master": Kind(("task",), "", r"prompts_v(?P<version>[^/-]+)(-[^/]*)?\.jsonl", "prompts_v{version}{part}.jsonl", MASTER),
    "results": Kind(("task", "model"), "generated_result", _RESULTS + r"(-[^/]*)?\.jsonl", "generated_result_v{version}{part}.jsonl", _renamed(RESULTS_WIDE)),
    "results_clean": Kind(("task", "model"), "generated_result", _RESULTS + r"(-[^/]*)?_wo_hf\.jsonl", "generated_result_v{version}{part}_wo_hf.jsonl", _renamed(RESULTS_CLEAN_WIDE)),
    "ctg_report": Kind(("task", "model", "iter"), "score", r"v(?P<version>[^_/]+)_ctg_score_(?P<iter>\d+)\.txt", "v{version}_ctg_score_{iter}.txt", _LINES, True),
    "quality_report": Kind(("task", "model"), "score", r"v(?P<version>[^_/]+)_quality_score\.txt", "v{version}_quality_score.txt", _LINES, True),
    "models": Kind(("task", "model"), "generated_result", _RESULTS + r".*\.jsonl", "", T.StructType([])),
}


def _open(path: str):
    """(file system, root) of a path or URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        where, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    else:
        where, root = fs.LocalFileSystem(), path
    return where, root.rstrip("/")


def _names(where, folder: str, kind: str) -> list:
    from pyarrow import fs

    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    want = fs.FileType.Directory if kind == "folder" else fs.FileType.File
    return sorted((i for i in found if i.type == want and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)


def _commits(where, root: str) -> list[dict]:
    """Writes that were committed but whose moves may not have ended."""
    from pyarrow import fs

    out = []
    for i in where.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True)):
        if i.base_name.endswith(".json"):
            with where.open_input_file(i.path) as f:
                out.append(json.loads(f.read()) | {"file": i.path})
    return out


def _finish(where, root: str) -> None:
    """Makes the moves of committed writes. Every step may be repeated: a
    file is only replaced while its staged successor is there."""
    from pyarrow import fs

    gone = lambda path: where.get_file_info(path).type == fs.FileType.NotFound
    for commit in _commits(where, root):
        for path in commit["remove"]:
            if not gone(path):
                where.delete_file(path)
        for staged, final in commit["moves"]:
            if not gone(staged):
                where.create_dir(posixpath.dirname(final), recursive=True)
                if not gone(final):
                    where.delete_file(final)
                where.move(staged, final)
        if not gone(commit["staging"]):
            where.delete_dir(commit["staging"])
        where.delete_file(commit["file"])


@dataclass
class _Range(InputPartition):
    path: str
    values: tuple
    start: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    files: list


class LayoutReader(DataSourceReader):
    def __init__(self, kind: Kind, options: dict):
        self.kind, self.root = kind, options["path"]
        self.version = options.get("version")
        self.split = int(options.get("split_bytes", 64 << 20))
        self.only: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in ("task", "model") and column in self.kind.path:
                self.only[column] = values & self.only.get(column, values)
            else:
                yield f

    def _folders(self, where, parent: str, column: str) -> list[str]:
        only = self.only.get(column)
        return [i.base_name for i in _names(where, parent, "folder") if only is None or i.base_name in only]

    def files(self) -> Iterator[tuple[str, tuple, int]]:
        """(path, path values, size) of every visible file."""
        where, root = _open(self.root)
        from pyarrow import fs

        open_commits = _commits(where, root)
        hidden = {x for c in open_commits for x in c["remove"]}
        # moves still to be made: the staged file counts, not what it replaces
        staged = {final: where.get_file_info(path) for c in open_commits for path, final in c["moves"]}
        staged = {final: info for final, info in staged.items() if info.type == fs.FileType.File}
        for task in self._folders(where, root, "task"):
            parents = [f"{root}/{task}"]
            if "model" in self.kind.path:
                parents = [f"{root}/{task}/{m}/{self.kind.folder}" for m in self._folders(where, f"{root}/{task}", "model")]
            for folder in parents:
                for info in _names(where, folder, "file"):
                    values = self._values(info.path, root)
                    if values is not None and info.path not in hidden and info.path not in staged:
                        yield info.path, values, info.size
        for final, info in staged.items():
            values = self._values(final, root)
            if values is not None and all(v in self.only.get(c, {v}) for c, v in zip(self.kind.path, values)):
                yield info.path, values, info.size

    def _values(self, path: str, root: str) -> tuple | None:
        """The path columns, or None for a file of another kind."""
        parts = path[len(root) + 1 :].split("/")
        depth = 2 if self.kind.path == ("task",) else 4
        match = re.fullmatch(self.kind.pattern, parts[-1])
        if len(parts) != depth or (depth == 4 and parts[2] != self.kind.folder) or not match or self.version not in (None, match["version"]):
            return None
        return tuple(int(match["iter"]) if c == "iter" else parts[i] for i, c in enumerate(self.kind.path))

    def partitions(self):
        out = []
        for path, values, size in self.files():
            if not self.kind.fields and not self.kind.lines:  # folders alone
                if not any(p.values == values for p in out[-1:]):
                    out.append(_Range(path, values, 0, 0))
                continue
            step = size if self.kind.lines else self.split
            out += [_Range(path, values, at, min(at + step, size)) for at in range(0, size, max(step, 1))]
        return out or [_Range("", (), 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.kind.schema())
        if not partition.path:
            return
        if not self.kind.fields:
            yield pa.RecordBatch.from_pylist([dict(zip(self.kind.path, partition.values))], schema)
            return
        fixed = dict(zip(self.kind.path, partition.values))
        rows, weight = [], 0
        for n, line in enumerate(self._lines(partition)):
            rows.append({**fixed, **({"line_no": n, "line": line.decode("utf-8", "replace")} if self.kind.lines else self._parsed(line))})
            weight += len(line)
            if len(rows) >= 1000 or weight > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def _lines(p: _Range, block: int = 4 << 20) -> Iterator[bytes]:
        """The lines that start in the range, without their ends."""
        where, _ = _open(p.path)
        with where.open_input_file(p.path) as f:
            at = p.start
            if at:  # the line that reaches into the range belongs to the one before
                f.seek(at - 1)
                at -= 1
                while chunk := f.read(block):
                    if (cut := chunk.find(b"\n")) >= 0:
                        at += cut + 1
                        break
                    at += len(chunk)
                f.seek(at)
            rest: list[bytes] = []
            while at < p.end and (chunk := f.read(block)):
                pieces = chunk.split(b"\n")
                for piece in pieces[:-1]:
                    line = b"".join([*rest, piece])
                    rest = []
                    if at < p.end:
                        yield line
                    at += len(line) + 1
                rest.append(pieces[-1])
                while at < p.end and sum(map(len, rest)) > 0 and (chunk := f.read(block)):
                    cut = chunk.find(b"\n")
                    if cut < 0:
                        rest.append(chunk)
                        continue
                    f.seek(f.tell() - len(chunk) + cut + 1)
                    line = b"".join([*rest, chunk[:cut]])
                    rest = []
                    yield line
                    at += len(line) + 1
            if at < p.end and (last := b"".join(rest)):
                yield last

    def _parsed(self, line: bytes) -> dict:
        try:
            row = json.loads(line)
            fields = {f.name: _typed(row.get("model" if f.name == "model_path" else f.name), f.dataType) for f in self.kind.fields}
            return fields | {"_corrupt_record": None}
        except (ValueError, AttributeError, TypeError):
            return {"_corrupt_record": line.decode("utf-8", "replace")}


def _typed(value, kind: T.DataType):
    """A JSON value as the column's type; numbers are read as their text where
    a text is wanted."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise TypeError(f"expected a list, got {value!r}")
        return [_typed(v, kind.elementType) for v in value]
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"expected a whole number, got {value!r}")
    return value


class LayoutWriter(DataSourceArrowWriter):
    def __init__(self, kind: Kind, options: dict, schema: T.StructType, overwrite: bool):
        missing = [c for c in kind.path if c not in schema.names] + [c for c in ("line_no", "line") if kind.lines and c not in schema.names]
        if missing or not kind.name:
            raise ValueError(f"cannot write this kind, or columns are missing: {missing}")
        self.kind, self.root, self.overwrite = kind, options["path"], overwrite
        self.version = options.get("version", "1")
        self.id = uuid4().hex
        where, root = _open(self.root)
        _finish(where, root)

    def _staging(self, root: str) -> str:
        return f"{root}/_staging/{self.id}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        where, root = _open(self.root)
        folder = f"{self._staging(root)}/{uuid4().hex}"  # a failed attempt shares nothing with the next one
        open_: dict[tuple, tuple[str, object]] = {}
        last: dict[tuple, int] = {}
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    group = tuple(row.pop(c) for c in self.kind.path)
                    if any(v is None or "/" in str(v) or str(v).startswith(("_", ".")) or v == "" for v in group):
                        raise ValueError(f"no folder can be named by {dict(zip(self.kind.path, group))}")
                    if group not in open_:
                        where.create_dir(folder, recursive=True)
                        name = f"{folder}/{len(open_):05}"
                        open_[group] = (name, where.open_output_stream(name))
                    if self.kind.lines:
                        if row["line_no"] <= last.get(group, -1):
                            raise ValueError(f"lines of {group} are not in order")
                        last[group] = row["line_no"]
                        text = row["line"] or ""
                    else:
                        if "model_path" in row:
                            row["model"] = row.pop("model_path")
                        text = json.dumps(row, ensure_ascii=False)
                    open_[group][1].write(text.encode() + b"\n")
        finally:
            for _, f in open_.values():
                f.close()
        return _Written([(name, group) for group, (name, _) in open_.items()])

    def _final(self, group: tuple, part: str) -> str:
        values = dict(zip(self.kind.path, group))
        folder = "/".join(str(values[c]) for c in ("task", "model") if c in values)
        name = self.kind.name.format(version=self.version, part=part, iter=values.get("iter"))
        return "/".join(x for x in (folder, self.kind.folder, name) if x)

    def commit(self, messages) -> None:
        where, root = _open(self.root)
        groups: dict[tuple, list[str]] = {}
        for m in messages:
            for name, group in m.files if m else []:
                groups.setdefault(group, []).append(name)
        if self.kind.lines and any(len(x) > 1 for x in groups.values()):
            raise ValueError("the lines of a report came from several tasks")
        moves, remove = [], []
        # the files of the groups as they are now: their own names, or names of this write
        reader = LayoutReader(self.kind, {"path": self.root, "version": self.version})
        old: dict[tuple, list[str]] = {}
        for path, values, _ in reader.files():
            old.setdefault(values, []).append(path)
        for group, names in sorted(groups.items(), key=repr):
            replace = self.overwrite or self.kind.lines or not old.get(group)
            if replace:
                remove += old.get(group, [])
            for n, name in enumerate(sorted(names)):
                part = "" if replace and len(names) == 1 else f"-{self.id}-{n:05}"
                moves.append((name, f"{root}/{self._final(group, part)}"))
        where.create_dir(f"{root}/_commits", recursive=True)
        finals = {final for _, final in moves}
        remove = [path for path in remove if path not in finals]
        entry = f"{root}/_commits/{self.id}"
        with where.open_output_stream(entry + ".tmp") as f:
            f.write(json.dumps({"staging": self._staging(root), "moves": moves, "remove": remove}).encode())
        where.move(entry + ".tmp", entry + ".json")  # the commit
        _finish(where, root)

    def abort(self, messages) -> None:
        from pyarrow import fs

        where, root = _open(self.root)
        committed = any(c["staging"] == self._staging(root) for c in _commits(where, root))
        if not committed and where.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            where.delete_dir(self._staging(root))


class LayoutDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _kind(self) -> Kind:
        kind = self.options.get("kind")
        if kind not in KINDS:
            raise ValueError(f"option kind: one of {sorted(KINDS)}, not {kind!r}")
        return KINDS[kind]

    def schema(self) -> T.StructType:
        return self._kind().schema()

    def reader(self, schema) -> LayoutReader:
        return LayoutReader(self._kind(), dict(self.options))

    def writer(self, schema, overwrite) -> LayoutWriter:
        return LayoutWriter(self._kind(), dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    from ..session import prepare

    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LayoutDataSource)


def read(spark: SparkSession, root: str, kind: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(kind=kind, **options).load(root)


def write(df: DataFrame, root: str, kind: str, mode: str = "overwrite", **options) -> None:
    """Writes rows with the kind's path columns. The rows of a report come
    to one task in order (a report is tens of lines); others stay where they
    are."""
    register(df.sparkSession)
    k = KINDS[kind]
    if k.lines:
        df = df.repartition(*k.path).sortWithinPartitions(*k.path, "line_no")
        df = df.select(*k.path, F.col("line_no").cast("int").alias("line_no"), "line")
    df.write.format(NAME).mode(mode).options(kind=kind, **options).save(root)
