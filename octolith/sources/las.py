"""LAS files: header, a data source (``format("las")``) and a writer.

A partition is a run of records of one file, so a large file is read by many tasks; a task maps its octets
to columns with one structured numpy view.  Compressed (LAZ) files are refused with a clear error: there
is no decoder without native code.  Files are opened, written and renamed through pyarrow's file systems, local or remote.
A written file passes through the task's own temporary folder, as its header needs the box and the counts of what follows.
"""

from __future__ import annotations

import glob
import math
import os
import re
import shutil
import struct
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BATCH = 1_000_000
#: Fixed values of the format: octets of a record and where red, green and blue are, by point format.
RECORD_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
RGB_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
GPS_AT = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}
SCHEMA = "pid long, x double, y double, z double, r int, g int, b int, a int, intensity int, flags int, flags2 int, classification int, gps_time double"
KNOWN = tuple(c.split()[0] for c in SCHEMA.split(", "))


@dataclass(frozen=True)
class LasHeader:
    version: tuple[int, int]
    header_size: int
    offset_to_points: int
    n_vlrs: int
    point_format: int
    record_bytes: int
    n_points: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    compressed: bool = False


@dataclass(frozen=True)
class Vlr:
    """Variable-length record: metadata after the header."""

    user_id: str
    record_id: int
    description: str
    data: bytes


def store_of(path: str):
    """File system and place of a path or URI; Hadoop's names of object stores are understood too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path) if ":/" in path else f"file://{os.path.abspath(path)}")


def _open(path: str):
    store, place = store_of(path)
    return store.open_input_file(place)


def parse_header(data: bytes) -> LasHeader:
    """From the first 375 octets."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    at = lambda kind, place: struct.unpack_from("<" + kind, data, place)[0]
    version = (data[24], data[25])
    n = at("Q", 247) if version >= (1, 4) and len(data) >= 255 else at("I", 107)
    raw = data[104]
    low, high = zip(*[(at("d", 187 + 16 * k), at("d", 179 + 16 * k)) for k in range(3)], strict=True)
    return LasHeader(version, at("H", 94), at("I", 96), at("I", 100), raw & 0x3F, at("H", 105), n, struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155), low, high, raw >= 0x80)


def read_header(path: str) -> LasHeader:
    with _open(path) as file:
        return parse_header(file.read(375))


def read_vlrs(path: str) -> list[Vlr]:
    with _open(path) as file:
        h = parse_header(file.read(375))
        file.seek(h.header_size)
        out = []
        for _ in range(h.n_vlrs):
            head = file.read(54)
            size = struct.unpack_from("<H", head, 20)[0]
            text = lambda b: b.split(b"\0")[0].decode("latin-1")
            out.append(Vlr(text(head[2:18]), struct.unpack_from("<H", head, 18)[0], text(head[22:54]), file.read(size)))
        return out


def geokeys(vlrs: Sequence[Vlr]) -> list[tuple[int, int, int, int]]:
    """(key, tag location, count, value) of the projection's directory."""
    for v in vlrs:
        if (v.user_id, v.record_id) == ("LASF_Projection", 34735):
            words = struct.unpack(f"<{len(v.data) // 2}H", v.data[: len(v.data) // 2 * 2])
            return [tuple(words[k : k + 4]) for k in range(4, len(words) - 3, 4)]
    return []


def with_vlr(vlrs: Sequence[Vlr], new: Vlr) -> list[Vlr]:
    """The records with ``new`` in place of the one with its user and number, or at the end."""
    same = [(v.user_id, v.record_id) == (new.user_id, new.record_id) for v in vlrs]
    return [new if hit else v for v, hit in zip(vlrs, same, strict=True)] + [new] * (not any(same))


def without_vlr(vlrs: Sequence[Vlr], user_id: str, record_id: int) -> list[Vlr]:
    return [v for v in vlrs if (v.user_id, v.record_id) != (user_id, record_id)]


def with_geokeys(vlrs: Sequence[Vlr], keys: Sequence[tuple[int, int, int, int]]) -> list[Vlr]:
    """Sets the projection's directory: (key, tag location, count, value) of each key."""
    words = [1, 1, 0, len(keys), *(w for key in keys for w in key)]
    return with_vlr(vlrs, Vlr("LASF_Projection", 34735, "", struct.pack(f"<{len(words)}H", *words)))


def with_geo_doubles(vlrs: Sequence[Vlr], values: Sequence[float]) -> list[Vlr]:
    return with_vlr(vlrs, Vlr("LASF_Projection", 34736, "", struct.pack(f"<{len(values)}d", *values)))


def with_geo_ascii(vlrs: Sequence[Vlr], text: str) -> list[Vlr]:
    return with_vlr(vlrs, Vlr("LASF_Projection", 34737, "", text.encode("ascii") + b"\0"))


def geo_doubles(vlrs: Sequence[Vlr]) -> list[float]:
    data = next((v.data for v in vlrs if (v.user_id, v.record_id) == ("LASF_Projection", 34736)), b"")
    return list(struct.unpack(f"<{len(data) // 8}d", data[: len(data) // 8 * 8]))


def geo_ascii(vlrs: Sequence[Vlr]) -> str:
    return next((v.data for v in vlrs if (v.user_id, v.record_id) == ("LASF_Projection", 34737)), b"").split(b"\0")[0].decode("ascii", "replace")


#: Fixed values of the format: kinds of extra attributes, by their number from 1 on.
EXTRA_KINDS = ("<u1", "<i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f4", "<f8")


@dataclass(frozen=True)
class Extra:
    """An attribute after the standard fields of a record; values are stored * scale + offset."""

    name: str
    kind: str = "<f8"
    scale: float = 1.0
    offset: float = 0.0


def extras_of(vlrs: Sequence[Vlr]) -> list[Extra]:
    """The attributes that the extra-bytes record describes, in their order."""
    data = next((v.data for v in vlrs if (v.user_id, v.record_id) == ("LASF_Spec", 4)), b"")
    out = []
    for k in range(0, len(data) - 191, 192):
        kind, options = data[k + 2], data[k + 3]
        if kind == 0:  # octets without a meaning: options has their number
            out.append(Extra(f"undocumented{k // 192}", f"V{options}"))
        elif kind <= len(EXTRA_KINDS):
            scale, offset = struct.unpack_from("<d", data, k + 112)[0], struct.unpack_from("<d", data, k + 136)[0]
            out.append(Extra(data[k + 4 : k + 36].split(b"\0")[0].decode("latin-1"), EXTRA_KINDS[kind - 1], scale if options & 8 else 1.0, offset if options & 16 else 0.0))
        else:
            raise ValueError(f"extra attribute of kind {kind}")
    return out


def with_extras(vlrs: Sequence[Vlr], extras: Sequence[Extra]) -> list[Vlr]:
    body = b""
    for e in extras:
        one = bytearray(192)
        one[2], one[3] = EXTRA_KINDS.index(e.kind) + 1, 8 * (e.scale != 1.0) + 16 * (e.offset != 0.0)
        one[4:36] = e.name.encode("latin-1")[:32].ljust(32, b"\0")
        struct.pack_into("<d", one, 112, e.scale)
        struct.pack_into("<d", one, 136, e.offset)
        body += bytes(one)
    return with_vlr(vlrs, Vlr("LASF_Spec", 4, "", body)) if extras else list(vlrs)


def record_dtype(point_format: int, record_bytes: int, extra: Sequence[tuple[str, str]] = ()) -> np.dtype:
    """The fields that are read, at their places; ``extra``: (name, numpy kind) of attributes after the standard ones."""
    names, kinds, places = ["X", "Y", "Z", "intensity"], ["<i4", "<i4", "<i4", "<u2"], [0, 4, 8, 12]

    def add(name: str, kind: str, place: int) -> None:
        names.append(name), kinds.append(kind), places.append(place)

    add("flags", "u1", 14)
    add("flags2", "u1", 15)  # classification in the legacy formats
    add("classification", "u1", 15 if point_format < 6 else 16)
    if point_format in GPS_AT:
        add("gps_time", "<f8", GPS_AT[point_format])
    if point_format in RGB_AT:
        add("rgb", "(3,)<u2", RGB_AT[point_format])
    place = RECORD_BYTES[point_format]
    for name, kind in extra:
        add(name, kind, place)
        place += np.dtype(kind).itemsize
    return np.dtype({"names": names, "formats": kinds, "offsets": places, "itemsize": record_bytes})


def narrow(c: np.ndarray) -> np.ndarray:
    """8-bit colours from 16-bit ones; those up to 255 are 8-bit already."""
    return np.where(c > 255, c // 256, c)


def decode(data: bytes, header: LasHeader, first_pid: int, columns: Sequence[str], move: Sequence[float] = (0, 0, 0), extras: Sequence[Extra] = ()) -> pa.RecordBatch:
    """The columns asked for, and no others, of a run of records; an extra attribute that the file lacks is null."""
    own = {e.name: e for e in extras}
    rows = np.frombuffer(data, dtype=record_dtype(header.point_format, header.record_bytes, [(f"extra:{e.name}", e.kind) for e in extras]))
    n, out = len(rows), []
    for name in columns:
        if name not in KNOWN:
            out.append(rows[f"extra:{name}"].astype(float) * own[name].scale + own[name].offset if name in own else np.ma.masked_all(n))
        elif name == "pid":
            out.append(np.arange(first_pid, first_pid + n))
        elif name in ("x", "y", "z"):
            k = "xyz".index(name)
            out.append(rows[name.upper()] * header.scale[k] + header.offset[k] + move[k])
        elif name in ("r", "g", "b"):
            out.append((narrow(rows["rgb"][:, "rgb".index(name)]) if header.point_format in RGB_AT else np.zeros(n)).astype(np.int32))
        elif name == "a":
            out.append(np.full(n, 255, dtype=np.int32))
        elif name == "gps_time":
            out.append(rows["gps_time"].copy() if "gps_time" in rows.dtype.names else np.full(n, np.nan))
        else:
            out.append(rows[name].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.float64()) if isinstance(c, np.ma.MaskedArray) else pa.array(np.ascontiguousarray(c)) for c in out], names=list(columns))


@dataclass
class Run(InputPartition):
    path: str
    first: int
    count: int
    pid: int
    move: tuple[float, ...] = (0.0, 0.0, 0.0)


def expand(path: str) -> list[str]:
    """The files that a path with ``*`` in its last part names, on any file system, by name."""
    if "*" not in path:
        return [path]
    from pyarrow import fs

    store, place = store_of(path)
    folder, _, name = place.rpartition("/")
    fits = re.compile(".*".join(map(re.escape, name.split("*"))))
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(path.rpartition("/")[0] + "/" + f.base_name for f in found if f.type == fs.FileType.File and fits.fullmatch(f.base_name) and f.base_name[0] not in "._")


def listed(options: dict[str, str]) -> tuple[list[str], list[int] | None, list[float] | None]:
    """Paths, and if given the number of each path's first point and what is taken from all coordinates."""
    paths = [p for x in options["path"].split(",") for p in expand(x)]
    starts = [int(x) for x in options["starts"].split(",")] if options.get("starts") else None
    return paths, starts, [float(x) for x in options["low"].split(",")] if options.get("low") else None


class LasReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]) -> None:
        self.columns = [f.name for f in schema.fields]
        self.paths, self.starts, self.low = listed(options)
        self.batch = int(options.get("batch", BATCH))
        self.translate = options.get("translate", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Headers are read once, here; a run carries what its task needs of the others."""
        heads = [read_header(path) for path in self.paths]
        for path, h in zip(self.paths, heads, strict=True):
            if h.compressed:
                raise ValueError(f"{path} is compressed (LAZ); decompress it to LAS first")
            if h.point_format not in RECORD_BYTES:
                raise ValueError(f"{path} has point format {h.point_format}")
        low = self.low or ([min(c) for c in zip(*[h.low for h in heads], strict=True)] if heads and self.translate else [0.0] * 3)
        out, pid = [], 0
        for k, (path, h) in enumerate(zip(self.paths, heads, strict=True)):
            pid = self.starts[k] if self.starts else pid
            out += [Run(path, at, min(self.batch, h.n_points - at), pid + at, tuple(-v for v in low)) for at in range(0, h.n_points, self.batch)]
            pid += h.n_points
        return out or [Run("", 0, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.count:
            return
        extras = extras_of(read_vlrs(run.path)) if any(c not in KNOWN for c in self.columns) else []
        with _open(run.path) as file:
            h = parse_header(file.read(375))
            file.seek(h.offset_to_points + run.first * h.record_bytes)
            for k in range(0, run.count, 65_536):
                n = min(65_536, run.count - k)
                data = file.read(n * h.record_bytes)
                if len(data) < n * h.record_bytes:
                    raise ValueError(f"{run.path} ends early")
                yield decode(data, h, run.pid + k, self.columns, run.move, extras)


def encode_header(h: LasHeader, vlrs: Sequence[Vlr] = (), system: str = "", software: str = "octolith", counts: Sequence[int] = (0,) * 5) -> bytes:
    """Header (version 1.2, or 1.4 for formats above 5 or many points) and its records."""
    wide = h.point_format > 5 or h.n_points >= 1 << 32
    size = 375 if wide else 227
    out = bytearray(size)
    out[:4], out[24], out[25] = b"LASF", 1, 4 if wide else 2
    out[26:58], out[58:90] = system.encode()[:32].ljust(32, b"\0"), software.encode()[:32].ljust(32, b"\0")
    body = b"".join(struct.pack("<H16sHH32s", 0, v.user_id.encode(), v.record_id, len(v.data), v.description.encode()) + v.data for v in vlrs)
    struct.pack_into("<HIIBH", out, 94, size, size + len(body), len(vlrs), h.point_format, h.record_bytes)
    legacy = 0 if wide else h.n_points
    struct.pack_into("<I5I", out, 107, legacy, *([0] * 5 if wide else counts))
    struct.pack_into("<3d3d", out, 131, *h.scale, *h.offset)
    for k in range(3):
        struct.pack_into("<dd", out, 179 + 16 * k, h.high[k], h.low[k])
    if wide:
        struct.pack_into("<Q", out, 247, h.n_points)
    return bytes(out) + body


def encode_points(x: np.ndarray, y: np.ndarray, z: np.ndarray, h: LasHeader, rgb: np.ndarray | None = None, more: dict[str, np.ndarray] | None = None, extras: Sequence[Extra] = ()) -> bytes:
    rows = np.zeros(len(x), dtype=record_dtype(h.point_format, h.record_bytes, [(f"extra:{e.name}", e.kind) for e in extras]))
    for k, v in enumerate((x, y, z)):
        q = (v - h.offset[k]) / h.scale[k]
        q = np.trunc(q + np.where(q >= 0, 0.5, -0.5))
        if len(q) and (q.max() >= 2**31 or q.min() < -(2**31)):
            raise ValueError("coordinates don't fit the scale and offset")
        rows["XYZ"[k]] = q
    if rgb is not None and "rgb" in rows.dtype.names:
        rows["rgb"] = rgb
    own = {e.name: e for e in extras}
    for name, v in (more or {}).items():
        if name in own:
            q = (np.asarray(v, dtype=float) - own[name].offset) / own[name].scale
            rows[f"extra:{name}"] = np.rint(q) if own[name].kind[1] in "iu" else q
        elif name in rows.dtype.names:
            rows[name] = v
    return rows.tobytes()


class LasStream:
    """A file written batch by batch, in bounded memory: records first, then the header with their box and counts."""

    def __init__(self, point_format: int = 2, scale: Sequence[float] = (0.001,) * 3, offset: Sequence[float] | None = None, vlrs: Sequence[Vlr] = (), extras: Sequence[Extra] = (), system: str = "", software: str = "octolith") -> None:
        self.format, self.scale, self.offset, self.vlrs, self.extras = point_format, tuple(scale), offset, with_extras(vlrs, extras), extras
        self.system, self.software = system, software
        self.n, self.low, self.high, self.returns = 0, [math.inf] * 3, [-math.inf] * 3, np.zeros(6, dtype=np.int64)
        self.body = tempfile.TemporaryFile()

    def _header(self) -> LasHeader:
        size = RECORD_BYTES[self.format] + sum(np.dtype(e.kind).itemsize for e in self.extras)
        box = (self.low, self.high) if self.n else ([0.0] * 3, [0.0] * 3)
        return LasHeader((1, 4 if self.format > 5 else 2), 0, 0, len(self.vlrs), self.format, size, self.n, self.scale, tuple(self.offset or (0.0,) * 3), *map(tuple, box))

    def add(self, x, y, z, rgb=None, **more) -> None:
        xyz = [np.asarray(v, dtype=float) for v in (x, y, z)]
        if not len(xyz[0]):
            return
        low, high = [float(v.min()) for v in xyz], [float(v.max()) for v in xyz]
        if self.offset is None:  # the middle of the first points, down to a multiple of ten million steps
            self.offset = tuple(math.floor((a + b) / 2 / s / 1e7) * 1e7 * s for a, b, s in zip(low, high, self.scale, strict=True))
        self.low, self.high = list(map(min, self.low, low)), list(map(max, self.high, high))
        number = np.asarray(more.get("flags", np.zeros(len(x))), dtype=int) & (15 if self.format > 5 else 7)
        self.returns += np.bincount(np.minimum(number, 5) * (number <= 5), minlength=6)
        self.body.write(encode_points(*xyz, self._header(), rgb, more, self.extras))
        self.n += len(xyz[0])

    def finish(self, path: str) -> LasHeader:
        store, place = store_of(path)
        store.create_dir(os.path.dirname(place), recursive=True)
        self.body.seek(0)
        with store.open_output_stream(place, compression=None) as out:
            out.write(encode_header(self._header(), self.vlrs, self.system, self.software, [int(k) for k in self.returns[1:]]))
            shutil.copyfileobj(self.body, out, 1 << 20)
        self.body.close()
        return self._header()


def write_las(path: str, x, y, z, *, point_format: int = 2, scale: Sequence[float] = (0.001,) * 3, offset: Sequence[float] | None = None, rgb=None, vlrs: Sequence[Vlr] = (), extras: Sequence[Extra] = (), system: str = "", software: str = "octolith", **more) -> LasHeader:
    """One whole file from arrays; the inventory (box, counts by return) goes into the header."""
    out = LasStream(point_format, scale, offset, vlrs, extras, system, software)
    out.add(x, y, z, rgb, **more)
    return out.finish(path)


@dataclass
class Written(WriterCommitMessage):
    path: str
    n: int


class LasWriter(DataSourceArrowWriter):
    """One file per task, under a temporary name until the job commits; batches pass through, a partition is never held.

    Options: scale (one number, or three), offset (three), point_format, system, software, extra (names of further columns, written as doubles).
    Columns named like the record's fields (intensity, flags, classification, gps_time...) are written too.
    """

    def __init__(self, schema, options: dict[str, str], overwrite: bool) -> None:
        self.names = [f.name for f in schema.fields]
        self.folder, self.options, self.overwrite = options["path"].rstrip("/"), dict(options), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, o = TaskContext.get(), self.options
        scale = [float(v) for v in o.get("scale", "0.001").split(",")]
        offset = [float(v) for v in o["offset"].split(",")] if "offset" in o else None
        extras = [Extra(n) for n in o.get("extra", "").split(",") if n]
        out = LasStream(int(o.get("point_format", 2)), scale * 3 if len(scale) == 1 else scale, offset, (), extras, o.get("system", ""), o.get("software", "octolith"))
        for b in iterator:
            at = {n: b.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(self.names)}
            rgb = np.stack([at[c] for c in "rgb"], axis=1) if all(c in at for c in "rgb") else None
            out.add(at["x"], at["y"], at["z"], rgb, **{n: v for n, v in at.items() if n not in ("pid", "x", "y", "z", "r", "g", "b", "a")})
        path = f"{self.folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}.las"
        if out.n:
            out.finish(path)
        return Written(path, out.n)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.folder)
        old = [store_of(p)[1] for p in expand(f"{self.folder}/part-*.las")] if self.overwrite else []
        for place in old:
            store.delete_file(place)
        first = 0 if self.overwrite else len(expand(f"{self.folder}/part-*.las"))
        for k, m in enumerate((x for x in messages if x and x.n), start=first):
            store.move(store_of(m.path)[1], f"{folder}/part-{k:05d}.las")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        for m in messages:
            store, place = store_of(m.path) if m else (None, None)
            if m and m.n and store.get_file_info(place).type == fs.FileType.File:
                store.delete_file(place)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LasReader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return LasWriter(schema, self.options, overwrite)


def read_las(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, extra: Sequence[str] = (), **options: str) -> DataFrame:
    """Points of LAS files; only ``columns`` are decoded.  ``extra``: attributes after the standard ones, by name, as doubles (null where a file lacks them)."""
    spark.dataSource.register(LasSource)
    wanted = ", ".join([c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns] + [f"`{n}` double" for n in extra])
    return spark.read.format("las").schema(wanted).options(path=",".join(paths), **options).load()


def inventory(points: DataFrame) -> DataFrame:
    """Counts by return and the box of points with return_number, x, y, z."""
    return points.groupBy("return_number").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
