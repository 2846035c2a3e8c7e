"""A binary patch file as a Spark data source: spark.read / df.write.format("patchfile").

Little-endian: a header of 32 bytes (magic, patches M, occurrences K, zero), M + 1 offsets, K hashes
and, in version 2, K pairs of doubles.  A patch's id is its place in the file.

The reader opens nothing but the header on the driver; each partition reads its own windows of the
sections, so a filter on patch_id narrows what is read at all.  The path is a POSIX path that all
executors see, or a URI that pyarrow can open.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..schema import OCCURRENCE

# Fixed values of the file format.
MAGIC_PLAIN, MAGIC_LOCATED = b"STPSPAT1", b"STPSPAT2"
HEADER = struct.Struct("<8sQQQ")
#: Occurrences of a batch that the reader hands to Spark.
BATCH = 1 << 16


class PatchFileError(ValueError):
    """The file is missing, damaged, or asked for patches that it lacks."""


def _open(path: str):
    if "://" in path:
        system, inner = pafs.FileSystem.from_uri(path)
    else:
        system, inner = pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))
    return system, inner


@dataclass
class Header:
    patches: int
    occurrences: int
    located: bool

    @property
    def offsets_at(self) -> int:
        return HEADER.size

    @property
    def hashes_at(self) -> int:
        return HEADER.size + 8 * (self.patches + 1)

    @property
    def places_at(self) -> int:
        return self.hashes_at + 8 * self.occurrences

    @property
    def size(self) -> int:
        return self.places_at + (16 * self.occurrences if self.located else 0)


def read_header(path: str) -> Header:
    """The header, after checking the magic and that the file has exactly the size it implies."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type != pafs.FileType.File:
        raise PatchFileError(f"no patch file at {path}")
    with system.open_input_file(inner) as f:
        raw = f.read(HEADER.size)
    if len(raw) < HEADER.size:
        raise PatchFileError(f"{path}: shorter than a header")
    magic, patches, occurrences, _ = HEADER.unpack(raw)
    if magic not in (MAGIC_PLAIN, MAGIC_LOCATED):
        raise PatchFileError(f"{path}: not a patch file")
    header = Header(patches, occurrences, magic == MAGIC_LOCATED)
    if info.size != header.size:
        raise PatchFileError(f"{path}: {info.size} bytes, {header.size} expected")
    return header


def read_window(path: str, begin: int, end: int, coords: bool = True):
    """Arrow batches of the occurrences of patches [begin, end)."""
    header = read_header(path)
    if not 0 <= begin <= end <= header.patches:
        raise PatchFileError(f"{path}: no patches [{begin}, {end}) among {header.patches}")
    system, inner = _open(path)
    with system.open_input_file(inner) as f:

        def section(at: int, count: int, dtype: str) -> np.ndarray:
            f.seek(at)
            return np.frombuffer(f.read(count * np.dtype(dtype).itemsize), dtype)

        offsets = section(header.offsets_at + 8 * begin, end - begin + 1, "<u8").astype(np.int64)
        if (np.diff(offsets) < 0).any() or offsets[0] < 0 or offsets[-1] > header.occurrences:
            raise PatchFileError(f"{path}: offsets are damaged")
        for low in range(int(offsets[0]), int(offsets[-1]), BATCH):
            n = min(BATCH, int(offsets[-1]) - low)
            at = np.arange(low, low + n)
            patch = np.searchsorted(offsets, at, "right") - 1
            hashes = section(header.hashes_at + 8 * low, n, "<i8")
            places = section(header.places_at + 16 * low, 2 * n, "<f8").reshape(-1, 2) if header.located and coords else None
            xy = [pa.array(places[:, k]) if places is not None else pa.nulls(n, pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(patch + begin, pa.int64()), pa.array((at - offsets[patch]).astype(np.int32)), pa.array(hashes, pa.int64()), *xy], names=OCCURRENCE.names)


@dataclass
class Window(InputPartition):
    begin: int
    end: int


class PatchFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.coords = options["path"], options.get("coords", "true").lower() != "false"
        self.header = read_header(self.path)
        self.slices = int(options.get("slices", "8"))
        self.begin, self.end = int(options.get("begin", "0")), int(options.get("end", str(self.header.patches)))
        if not 0 <= self.begin <= self.end <= self.header.patches:
            raise PatchFileError(f"{self.path}: no patches [{self.begin}, {self.end}) among {self.header.patches}")
        if options.get("located", "false").lower() == "true" and not self.header.located:
            raise PatchFileError(f"{self.path}: statistics need locations")

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("patch_id",) and isinstance(getattr(f, "value", None), int):
                low, high = {
                    EqualTo: (f.value, f.value + 1),
                    GreaterThan: (f.value + 1, self.end),
                    GreaterThanOrEqual: (f.value, self.end),
                    LessThan: (self.begin, f.value),
                    LessThanOrEqual: (self.begin, f.value + 1),
                }.get(type(f), (self.begin, self.end))
                self.begin = min(max(self.begin, low), self.end)
                self.end = max(min(self.end, high), self.begin)
            yield f  # Spark applies it again, which is harmless

    def partitions(self):
        m, p = self.end - self.begin, max(1, min(self.slices, self.end - self.begin))
        return [Window(self.begin + m * r // p, self.begin + m * (r + 1) // p) for r in range(p)]

    def read(self, partition: Window):
        yield from read_window(self.path, partition.begin, partition.end, self.coords)


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    first: int
    last: int
    sizes: list
    located: bool
    split: bool
    place: int


class PatchFileWriter(DataSourceArrowWriter):
    """Each task writes its hashes and places beside the target; the commit puts the sections in order.

    Rows are patches (patch_id, occ) or, in order, occurrences (patch_id, hash, x, y); partitions may then share a patch.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.located, self.overwrite = options["path"], options.get("coords", "true").lower() != "false", overwrite

    def write(self, batches):
        import uuid

        from pyspark import TaskContext

        system, inner = _open(self.path)
        name, ids, sizes, split = f"{inner}.{uuid.uuid4().hex}", [], [], False
        with system.open_output_stream(f"{name}.h") as hashes, system.open_output_stream(f"{name}.p") as places:
            for batch in batches:
                own = batch.column("patch_id").to_numpy(zero_copy_only=False)
                split = "occ" not in batch.schema.names
                if (np.diff(np.concatenate((ids[-1:], own))) < (0 if split else 1)).any():
                    raise PatchFileError("patches do not come in ascending order of distinct ids; use write_patches()")
                if split:
                    columns = {c: batch.column(c) for c in ("hash", "x", "y")}
                    own, counts = np.unique(own, return_counts=True)
                    if ids and len(own) and ids[-1] == own[0]:
                        sizes[-1] += int(counts[0])
                        own, counts = own[1:], counts[1:]
                    sizes += counts.tolist()
                else:
                    occ = batch.column("occ")
                    columns = dict(zip(("hash", "x", "y"), (occ.flatten().field(c) for c in ("hash", "x", "y")), strict=True))
                    sizes += [n or 0 for n in pa.compute.list_value_length(occ).to_pylist()]
                ids += own.tolist()
                hashes.write(columns["hash"].to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                if self.located:
                    xy = [columns[c].to_numpy(zero_copy_only=False).astype("<f8") for c in ("x", "y")]
                    if any(columns[c].null_count for c in ("x", "y")):
                        raise PatchFileError("an occurrence has no location; write with coords=false")
                    places.write(np.column_stack(xy).tobytes())
        return Part(name if ids else self._drop(system, name), ids[0] if ids else 0, ids[-1] if ids else 0, sizes, self.located, split, TaskContext.get().partitionId())

    @staticmethod
    def _drop(system, name):
        for kind in "hp":
            if system.get_file_info(f"{name}.{kind}").type == pafs.FileType.File:
                system.delete_file(f"{name}.{kind}")

    def commit(self, messages):
        system, inner = _open(self.path)
        parts = sorted((m for m in messages if m and m.name), key=lambda m: m.place if m.split else m.first)
        if any(a.last > b.first or a.last == b.first and not b.split for a, b in zip(parts, parts[1:], strict=False)):
            self.abort(messages)
            raise PatchFileError("partitions overlap in patch ids; use write_patches()")
        for a, b in zip(parts, parts[1:], strict=False):
            if a.last == b.first:  # the patch counts where it ends
                b.sizes[0] += a.sizes.pop()
        sizes = np.concatenate([np.array(p.sizes, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
        with system.open_output_stream(f"{inner}.new") as out:
            out.write(HEADER.pack(MAGIC_LOCATED if self.located else MAGIC_PLAIN, len(sizes), int(offsets[-1]), 0))
            out.write(offsets.tobytes())
            for kind in "hp" if self.located else "h":
                for p in parts:
                    with system.open_input_stream(f"{p.name}.{kind}") as f:
                        while block := f.read(1 << 24):
                            out.write(block)
                    system.delete_file(f"{p.name}.{kind}")  # so that no more than a part is there twice
        system.move(f"{inner}.new", inner)
        for p in parts:
            self._drop(system, p.name)

    def abort(self, messages):
        system, _ = _open(self.path)
        for m in messages:
            if m and m.name:
                self._drop(system, m.name)


class PatchFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "patchfile"

    def schema(self):
        read_header(self.options["path"])
        return OCCURRENCE

    def reader(self, schema):
        return PatchFileReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return PatchFileWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PatchFile)


def read_patches(spark: SparkSession, path: str, slices: int = 8, **options) -> DataFrame:
    """Occurrences of the file; located=True insists on locations, coords=False leaves them out."""
    register(spark)
    given = {k: str(v).lower() for k, v in options.items()}
    return spark.read.format("patchfile").options(slices=str(slices), **given).load(path)


def write_patches(nested: DataFrame, path: str, coords: bool = True) -> None:
    """Write (patch_id, occ), one row per patch, in order of the ids."""
    register(nested.sparkSession)
    ordered = nested.select("patch_id", "occ").repartitionByRange("patch_id").sortWithinPartitions("patch_id")
    ordered.write.format("patchfile").mode("overwrite").option("coords", str(coords).lower()).save(path)


def write_occurrences(occurrence: DataFrame, path: str, coords: bool = True) -> None:
    """Write occurrences in order of patch and position, or of hash, x and y where positions agree or are null.

    One shuffle, and no row or task that grows with a patch; a patch without occurrences is not written.
    """
    register(occurrence.sparkSession)
    order = ("patch_id", "pos", "hash", "x", "y")
    ordered = occurrence.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("patch_id", "hash", "x", "y")
    ordered.write.format("patchfile").mode("overwrite").option("coords", str(coords).lower()).save(path)
