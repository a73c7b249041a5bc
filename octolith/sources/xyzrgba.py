"""Files of 16 octets per point (three 32-bit floats, four colour octets) after a box of six floats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from octolith.sources.las import BATCH, _open, expand, listed, store_of

HEADER_BYTES, POINT_BYTES = 24, 16
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("a", "u1")])
SCHEMA = "pid long, x double, y double, z double, r int, g int, b int, a int"


def read_box(path: str) -> tuple[tuple[float, ...], tuple[float, ...], int]:
    """Lower and upper corner, and the number of points."""
    with _open(path) as file:
        box = np.frombuffer(file.read(HEADER_BYTES), dtype="<f4").astype(float)
        return tuple(map(float, box[:3])), tuple(map(float, box[3:])), (file.size() - HEADER_BYTES) // POINT_BYTES


@dataclass
class Run(InputPartition):
    path: str
    first: int
    count: int
    pid: int
    low: tuple[float, ...] = (0.0, 0.0, 0.0)


class XyzrgbaReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]) -> None:
        self.columns = [f.name for f in schema.fields]
        self.paths, self.starts, self.low = listed(options)
        self.batch = int(options.get("batch", BATCH))
        self.translate = options.get("translate", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        boxes = [read_box(path) for path in self.paths]
        low = self.low or ([min(c) for c in zip(*[b[0] for b in boxes], strict=True)] if boxes and self.translate else [0.0] * 3)
        out, pid = [], 0
        for k, (path, (_, _, n)) in enumerate(zip(self.paths, boxes, strict=True)):
            pid = self.starts[k] if self.starts else pid
            out += [Run(path, at, min(self.batch, n - at), pid + at, tuple(low)) for at in range(0, n, self.batch)]
            pid += n
        return out or [Run("", 0, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.count:
            return
        low = dict(zip("xyz", run.low, strict=True))
        with _open(run.path) as file:
            file.seek(HEADER_BYTES + POINT_BYTES * run.first)
            for k in range(0, run.count, 65_536):
                rows = np.frombuffer(file.read(POINT_BYTES * min(65_536, run.count - k)), dtype=POINT)
                made = {"pid": np.arange(run.pid + k, run.pid + k + len(rows))}
                arrays = [made[c] if c == "pid" else rows[c].astype(float) - low[c] if c in low else rows[c].astype(np.int32) for c in self.columns]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=self.columns)


class XyzrgbaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xyzrgba"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return XyzrgbaReader(schema, self.options)


def read_xyzrgba(spark: SparkSession, *paths: str, **options: str) -> DataFrame:
    spark.dataSource.register(XyzrgbaSource)
    return spark.read.format("xyzrgba").options(path=",".join(paths), **options).load()


def encode(x, y, z, rgba, low) -> bytes:
    rows = np.zeros(len(x), dtype=POINT)
    for n, v, m in zip("xyz", (x, y, z), low, strict=True):
        rows[n] = np.asarray(v, dtype=float) - m
    for k, n in enumerate("rgba"):
        rows[n] = np.asarray(rgba)[:, k] if len(x) else []
    return rows.tobytes()


def write_xyzrgba(points: DataFrame, folder: str) -> int:
    """Files (one per task) of points with x, y, z, r, g, b, moved to the origin; returns the number of points.

    The box is one aggregation; every file carries it, so each can be read alone.
    """
    box = points.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low, high = ([float(box[f"{n}{c}"] or 0) for c in "xyz"] for n in ("lo", "hi"))
    head = np.array([0, 0, 0, *[b - a for a, b in zip(low, high, strict=True)]], dtype="<f4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        store, place = store_of(folder)
        store.create_dir(place, recursive=True)
        part = f".part-{task.partitionId():05d}-{task.taskAttemptId()}"
        with store.open_output_stream(f"{place}/{part}", compression=None) as file:
            file.write(head)
            for b in batches:
                c = [b.column(k).to_numpy() for k in range(6)]
                file.write(encode(*c[:3], np.stack([*c[3:], np.full(b.num_rows, 255)], axis=1), low))
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n])], names=["part", "n"])

    for old in expand(f"{folder}/part-*.xyzrgba"):
        store, place = store_of(old)
        store.delete_file(place)
    # a task's name counts once its attempt has ended; then the driver renames, as it would commit a job
    done = points.select("x", "y", "z", *[F.col(c).cast("int") for c in "rgb"]).mapInArrow(run, "part string, n long").collect()
    store, place = store_of(folder)
    for k, row in enumerate(r for r in sorted(done) if r.n):
        store.move(f"{place}/{row.part}", f"{place}/part-{k:05d}.xyzrgba")
    for row in done:
        if not row.n:
            store.delete_file(f"{place}/{row.part}")
    return sum(r.n for r in done)
