"""Tar tiles of text curves as a data source: read by byte ranges, written in parts that are committed together.

Reading.  A partition is a range of a tar file's bytes, and its members are those whose header begins in
the range: headers stand on multiples of 512 bytes and carry a magic word and a checksum, so a task
finds the first one by itself and goes on from header to header, over the members it doesn't
want without reading them.  So neither is a tar a row or a task, nor does the driver look into one; one curve is read by
its headers and its own bytes.  Contents must not look like tar headers themselves (texts don't).

Writing.  A tile may be written by many tasks: each writes a tar of its own curves for every tile it
meets, ``<tile>.<part>.tar``, below ``_temporary``, and the commit moves them into place.  A retry leaves nothing
that a reader could see.

File systems are those of ``pyarrow.fs`` (local and mounted ones, HDFS, object stores).
"""

from __future__ import annotations

import fnmatch
import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .curves import parse_curve

SPLIT = 64 << 20
BLOCK = 512
ROWS = 50_000
OBSERVED = "tile string, id string, band string, t double, mag double, err double, problem string"
PACKED = "tile string, id string, band string, t double, mag double, err double"


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path there, and the pattern of its files' names."""
    path, pattern = path.rsplit("/", 1) if any(c in path for c in "*?[") else (path, "*.tar")
    return *fs.FileSystem.from_uri(path), pattern


def _files(path: str) -> list[fs.FileInfo]:
    """Files at a path: itself, all ``.tar`` below a folder, or those whose names match."""
    system, base, pattern = _system(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return [info]
    if info.type != fs.FileType.Directory:
        return []
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and "/_temporary/" not in f.path and fnmatch.fnmatch(f.base_name, pattern)), key=lambda f: f.path)


def _header(block: bytes) -> tarfile.TarInfo | None:
    """A member's header, if the block is one."""
    if len(block) < BLOCK or block[257:262] != b"ustar":
        return None
    try:
        return tarfile.TarInfo.frombuf(block, "utf-8", "replace")
    except tarfile.HeaderError:
        return None


def members(file, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(name, place, size) of the files whose headers begin in [begin, end) of an open tar."""
    at = -(-begin // BLOCK) * BLOCK
    if at:  # on to the first header
        while at < end:
            file.seek(at)
            chunk = file.read(min(1 << 20, end - at) // BLOCK * BLOCK or BLOCK)
            found = next((i for i in range(0, len(chunk), BLOCK) if _header(chunk[i : i + BLOCK])), None)
            if found is not None:
                at += found
                break
            if not chunk:
                return
            at += len(chunk)
    while at < end:
        file.seek(at)
        head = _header(file.read(BLOCK))
        if head is None:
            return  # the end's blocks of zeros
        if head.isfile():
            yield head.name, at + BLOCK, head.size
        at += BLOCK + -(-head.size // BLOCK) * BLOCK


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.wanted = options.get("id"), options.get("band")

    def partitions(self) -> list[Range]:
        return [Range(f.path, at, min(at + self.split, f.size)) for f in _files(self.path) for at in range(0, f.size, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            system, *_ = _system(self.path)
            tile = part.path.rpartition("/")[2].partition(".")[0]
            with system.open_input_file(part.path) as file:
                for name, at, size in members(file, part.begin, part.end):
                    identifier, band = curve_name(name)
                    if name.endswith(".mjd") and all(w in (None, own) for w, own in zip(self.wanted, (identifier, band), strict=True)):
                        file.seek(at)
                        yield from _observed(tile, identifier, band, file.read(size).decode("utf-8", "replace"))


def curve_name(name: str) -> tuple[str, str]:
    """``lc_<field>.<tile>.<seq>.<band>.mjd`` gives id and band."""
    identifier, _, band = name.rsplit("/", 1)[-1].removeprefix("lc_").removesuffix(".mjd").rpartition(".")
    return identifier, band


def _observed(tile: str, identifier: str, band: str, text: str) -> Iterator[pa.RecordBatch]:
    seen, problem = parse_curve(text)
    rows = [(None, None, None, problem)] * (problem is not None) + [(*r, None) for r in seen]
    kinds = [pa.float64()] * 3 + [pa.string()]
    for at in range(0, len(rows), ROWS):
        own = rows[at : at + ROWS]
        columns = [pa.array([x] * len(own), pa.string()) for x in (tile, identifier, band)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in own], k) for i, k in enumerate(kinds))], ["tile", "id", "band", "t", "mag", "err", "problem"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """Rows (tile, id, band, t, mag, err) stand by tile, id and band; a tar for each tile."""
        system, base = fs.FileSystem.from_uri(self.path)
        folder, written = f"{base.rstrip('/')}/_temporary/{self.job}", []
        part, out, tile = uuid.uuid4().hex[:12], None, None
        system.create_dir(folder, recursive=True)
        for key, own in _curves(batches):
            if out is None or key[0] != tile:
                if out is not None:
                    out.close()
                    stream.close()
                tile, name = key[0], f"{key[0]}.{part}.tar"
                stream = system.open_output_stream(f"{folder}/{name}")
                out = tarfile.open(fileobj=stream, mode="w|")
                written.append(name)
            text = _text(*key[1:], own)
            member = tarfile.TarInfo(f"lc_{key[1]}.{key[2]}.mjd")
            member.size = len(text)
            out.addfile(member, io.BytesIO(text))
        if out is not None:
            out.close()
            stream.close()
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.path)
        base = base.rstrip("/")
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{base}/_temporary/{self.job}/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.path)
        top = f"{base.rstrip('/')}/_temporary"
        if system.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.job}")
            if not system.get_file_info(fs.FileSelector(top)):  # no other writer's
                system.delete_dir(top)


def _curves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str, str], list[pa.RecordBatch]]]:
    """Runs of rows of one curve, from rows that stand by curve."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(a, z - a))
    if held:
        yield last, held


def _text(identifier: str, band: str, parts: list[pa.RecordBatch]) -> bytes:
    """Two lines of preamble, a header, and a line for each observation; null and NaN are ``?``."""
    lines = [f"# {identifier}", f"# band {band}", "t mag err"]
    shown = lambda x: "?" if x is None or x != x else repr(x)
    for p in parts:
        lines += [" ".join(map(shown, r)) for r in zip(*(pc.cast(p.column(i), pa.float64()).to_pylist() for i in (3, 4, 5)), strict=True)]
    return "\n".join(lines).encode()


class CurveTar(DataSource):
    """Format ``curve_tar``; options ``path``, ``split`` (bytes of a range), ``id`` and ``band`` (of one curve)."""

    @classmethod
    def name(cls) -> str:
        return "curve_tar"

    def schema(self) -> str:
        return OBSERVED

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("tiles are added to; choose a new folder")
        return _Writer(dict(self.options))


def _source(spark: SparkSession, **options: str):
    spark.dataSource.register(CurveTar)
    return spark.read.format("curve_tar").options(**options)


def read_tar_tiles(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(tile, id, band, t, mag, err, problem) of every ``.mjd`` member of the tar files at ``path``, by ranges of ``split`` bytes.

    A curve that can't be read gives one row with ``problem`` besides what was read of it; it stops nothing else.
    """
    return _source(spark, split=str(split)).load(path)


def read_curve(spark: SparkSession, path: str, identifier: str, band: str, split: int = SPLIT) -> DataFrame:
    """The observations of one curve in one band, read by its headers and its own bytes."""
    return _source(spark, split=str(split), id=identifier, band=band).load(path)


def write_tar_tiles(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """Curves (tile, id, band, t, mag, err) as tar files of text curves, in ``parts`` tasks, as many as shuffles
    have unless given; a tile may have a file from each."""
    spark = rows.sparkSession
    spark.dataSource.register(CurveTar)
    order = ["tile", "id", "band", "t", "mag", "err"]
    own = rows.select(*[F.col(c).cast("string").alias(c) for c in order[:3]], *[F.col(c).cast("double").alias(c) for c in order[3:]])
    dealt = own.repartition(parts, *order[:3]) if parts else own.repartition(*order[:3])
    dealt.sortWithinPartitions(*order).write.format("curve_tar").mode("append").save(path)
