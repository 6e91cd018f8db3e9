"""imzML as a Spark data source: an XML header that says where each spectrum's arrays lie in a binary file beside it.

    spark.dataSource.register(ImzML)
    spark.read.format("imzml").load(path)
    df.coalesce(1).write.format("imzml").mode("append").save(path)

The header is parsed once on the driver, in a stream; tasks read ranges of spectra by offset. Continuous files (one
m/z array for all) and processed ones (one each) are read alike. Paths go through Arrow's file systems.
"""

from __future__ import annotations

import re
import uuid
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.tables import dense, written

SCHEMA = "image_id string, spectrum_id bigint, x int, y int, mz array<double>, intensity array<float>"

# Fixed values of the format: accessions of its controlled vocabulary.
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
TYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}
X, Y, OFFSET, LENGTH = "IMS:1000050", "IMS:1000051", "IMS:1000102", "IMS:1000103"
PROCESSED, UUID = "IMS:1000031", "IMS:1000080"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _binary(path: str) -> str:
    return (path[: -len(".imzML")] if path.lower().endswith(".imzml") else path) + ".ibd"


@dataclass
class Place:
    """Where a spectrum's two arrays lie: offset, number of values and type of each. None: the header doesn't tell."""

    number: int
    x: int | None
    y: int | None
    mz: tuple[int, int, str] | None
    intensity: tuple[int, int, str] | None


def header(path: str) -> Iterator[Place]:
    """The spectra of a header in order; elements are dropped once read."""
    fs, name = _file_system(path)
    groups: dict[str, dict[str, str]] = {}
    with fs.open_input_stream(name) as stream:
        number = 0
        local = lambda e: e.tag.rpartition("}")[2]
        for _, e in ET.iterparse(stream, events=("end",)):
            kind = local(e)
            if kind == "referenceableParamGroup":
                groups[e.get("id")] = {p.get("accession"): p.get("value", "") for p in e if local(p) == "cvParam"}
            elif kind == "spectrum":
                at: dict[str, int] = {}
                arrays = {}
                for p in e.iter():
                    if local(p) == "cvParam" and p.get("accession") in (X, Y):
                        at[p.get("accession")] = int(p.get("value"))
                    elif local(p) == "binaryDataArray":
                        known: dict[str, str] = {}
                        for q in p:
                            if local(q) == "referenceableParamGroupRef":
                                known |= groups.get(q.get("ref"), {})
                            elif local(q) == "cvParam":
                                known[q.get("accession")] = q.get("value", "")
                        kinds = [TYPES[a] for a in known if a in TYPES]
                        which = next((a for a in (MZ_ARRAY, INTENSITY_ARRAY) if a in known), None)
                        if which and kinds:
                            arrays[which] = (int(known[OFFSET]), int(known[LENGTH]), kinds[0])
                yield Place(number, at.get(X), at.get(Y), arrays.get(MZ_ARRAY), arrays.get(INTENSITY_ARRAY))
                number += 1
                e.clear()


@dataclass
class Places(InputPartition):
    """Spectra of a file, whose numbers count from `first`; places None: all of them, and the task reads the header."""

    path: str
    image: str
    first: int
    places: list[Place] | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path.rstrip("/"), per_task

    def partitions(self) -> list[Places]:
        fs, name = _file_system(self.path)
        last = self.path.rpartition("/")[2]
        if fs.get_file_info(name).type == pafs.FileType.Directory:  # parts of an image: each task reads the header of its own
            found = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(name)) if f.base_name.lower().endswith(".imzml") and not f.base_name.startswith("."))
            return [Places(f"{self.path}/{f}", last, k << 32, None) for k, f in enumerate(found)] or [Places(self.path, last, 0, [])]
        places, image = list(header(self.path)), last.rpartition(".")[0]
        return [Places(self.path, image, 0, places[k : k + self.per_task]) for k in range(0, len(places), self.per_task)] or [Places(self.path, image, 0, [])]

    def read(self, partition: Places):
        if partition.places == []:
            return
        fs, name = _file_system(_binary(partition.path))
        with fs.open_input_file(name) as f:
            for p in header(partition.path) if partition.places is None else partition.places:
                arrays = []
                for place in (p.mz, p.intensity):
                    if place is None:
                        arrays.append(None)
                        continue
                    offset, n, kind = place
                    f.seek(offset)
                    arrays.append(np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind).astype(float).tolist())
                yield partition.image, partition.first + p.number, p.x, p.y, *arrays


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: list[tuple[int, int, int]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Part:
        fs, name = _file_system(_binary(self.path))
        part, rows = f"{name}.{uuid.uuid4().hex}", []
        with fs.open_output_stream(part) as out:
            for row in iterator:
                mz, intensity = np.asarray(row["mz"] or [], "<f8"), np.asarray(row["intensity"] or [], "<f4")
                if len(mz) != len(intensity):
                    raise ValueError(f"arrays of unequal length at ({row['x']}, {row['y']})")
                out.write(mz.tobytes() + intensity.tobytes())
                rows.append((row["x"], row["y"], len(mz)))
        return _Part(part, rows)

    def commit(self, messages: list[_Part | None]) -> None:
        own, (fs, name) = uuid.uuid4(), _file_system(_binary(self.path))
        spectra, offset = [], 16
        with fs.open_output_stream(name) as out:
            out.write(own.bytes)
            for part in filter(None, messages):
                with fs.open_input_stream(part.name) as f:
                    while piece := f.read(1 << 20):
                        out.write(piece)
                fs.delete_file(part.name)
                for x, y, n in part.rows:
                    spectra.append((x, y, n, offset, offset + 8 * n))
                    offset += 12 * n
        with fs.open_output_stream(_file_system(self.path)[1]) as out:
            for line in _xml(own, spectra):
                out.write(line.encode())

    def abort(self, messages: list[_Part | None]) -> None:
        fs, _ = _file_system(_binary(self.path))
        for part in filter(None, messages):
            fs.delete_file(part.name)


def _xml(own: uuid.UUID, spectra: list[tuple[int, int, int, int, int]]) -> Iterator[str]:
    term = lambda accession, value="": f'<cvParam cvRef="{accession[:accession.index(":")]}" accession="{accession}" name="" value={quoteattr(str(value))}/>'
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1">\n'
    yield f"<fileDescription><fileContent>{term(PROCESSED)}{term(UUID, own)}</fileContent></fileDescription>\n"
    yield ('<referenceableParamGroupList count="2"><referenceableParamGroup id="mzArray">' + term(MZ_ARRAY) + term("MS:1000523") + "</referenceableParamGroup>"
           '<referenceableParamGroup id="intensityArray">' + term(INTENSITY_ARRAY) + term("MS:1000521") + "</referenceableParamGroup></referenceableParamGroupList>\n")
    yield f'<run id="run"><spectrumList count="{len(spectra)}">\n'
    for k, (x, y, n, at_mz, at_intensity) in enumerate(spectra):
        array = lambda group, at, size: (f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{group}"/>{term(OFFSET, at)}{term(LENGTH, n)}'  # noqa: E731,B023
                                         f'{term("IMS:1000104", size * n)}<binary/></binaryDataArray>')  # noqa: B023
        yield (f'<spectrum id="Scan={k + 1}" index="{k}" defaultArrayLength="0"><scanList count="1"><scan>{term(X, x)}{term(Y, y)}</scan></scanList>'
               f'<binaryDataArrayList count="2">{array("mzArray", at_mz, 8)}{array("intensityArray", at_intensity, 4)}</binaryDataArrayList></spectrum>\n')
    yield "</spectrumList></run></mzML>\n"


class ImzML(DataSource):
    """Spectra of one file, or of all files of a folder as one image, each of which is a task's.

    Option spectra_per_task (4096): how many spectra of a single file a task reads. A spectrum whose header lacks a
    coordinate or an array has null there: `mz.rejects` tells them, `mz.sound` leaves them out. Numbers of spectra count
    from 0 in a file, in a folder's k-th file from k times 2 ** 32.
    """

    @classmethod
    def name(cls) -> str:
        return "imzml"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return path.removeprefix("file://") if path.startswith("file:///") else path

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path(), int(self.options.get("spectra_per_task", 4096)))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._path())


def _dense(pixels, axis):
    """A row for each pixel with its spectrum on the whole axis."""
    mzs = axis.agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mz"))), lambda r: r["mz"]).alias("mz"))  # one row
    packed = pixels.groupBy("image_id", "x", "y").agg(F.collect_list(F.struct("bin", "intensity")).alias("_at")).crossJoin(F.broadcast(mzs))
    whole = packed.withColumn("intensity", dense(F.col("_at"), F.size("mz"), "bin", "intensity").cast("array<float>"))
    return whole.select(F.col("image_id").cast("string").alias("image_id"), F.lit(0).cast("long").alias("spectrum_id"), "x", "y", "mz", "intensity")


def export_imzml(pixels, axis, path: str) -> None:
    """Writes labelled pixels (image_id, x, y, bin, intensity) of one image as dense spectra on the axis, in raster order, to one file."""
    pixels.sparkSession.dataSource.register(ImzML)
    _dense(pixels, axis).orderBy("y", "x").write.format("imzml").mode("append").save(path)


def file_name(image_id: str) -> str:
    """A file name for an image: its id, or where that has other signs than letters, digits, dots, lines and underscores, these replaced and a checksum added."""
    plain = re.sub(r"[^\w.-]", "_", image_id)
    return plain if plain == image_id and plain.strip(".") else f"{plain}-{zlib.crc32(image_id.encode()):08x}"


def _write_images(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder.rstrip("/"))
        image, piece, out, part, own, spectra, offset = None, None, None, "", uuid.uuid4(), [], 16

        def close() -> Iterator[pa.RecordBatch]:
            if image is None:
                return
            out.close()
            name = f"{root}/{file_name(image)}"
            if piece is not None:
                fs.create_dir(name, recursive=True)
                name += f"/{piece:08d}"
            with fs.open_output_stream(f"{part}.imzML") as header_out:
                for line in _xml(own, spectra):
                    header_out.write(line.encode())
            for ending in (".ibd", ".imzML"):  # whole files take their names at the end: a lost task leaves none
                fs.move(part + ending, name + ending)
            yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([f"{name}.imzML"]), pa.array([len(spectra)])], ["image_id", "path", "spectra"])

        for batch in batches:
            for k in range(batch.num_rows):
                name, of, x, y = (batch.column(c)[k].as_py() for c in ("image_id", "piece", "x", "y"))
                if (name, of) != (image, piece):
                    yield from close()
                    image, piece, own, spectra, offset = name, of, uuid.uuid4(), [], 16
                    part = f"{root}/.{own.hex}"
                    out = fs.open_output_stream(f"{part}.ibd")
                    out.write(own.bytes)
                mz, intensity = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(kind) for c, kind in (("mz", "<f8"), ("intensity", "<f4")))
                out.write(mz.tobytes() + intensity.tobytes())
                spectra.append((x, y, len(mz), offset, offset + 8 * len(mz)))
                offset += 12 * len(mz)
        yield from close()

    return run


def export_images(pixels, axis, folder: str, lines: int | None = None):
    """Writes labelled pixels of any number of images, a file for each, and returns (image_id, path, spectra).

    A file is a stream through one task, which holds a spectrum and the places of the others; files are written side by
    side. `folder` must be one that all executors share. With `lines`, an image is a folder with a file for each so many
    lines that hold a pixel, so that a large image isn't one task's; the data source reads such a folder as one image.
    """
    fs, root = _file_system(folder.rstrip("/"))
    fs.create_dir(root, recursive=True)
    piece = F.lit(None).cast("long") if lines is None else F.floor(F.col("y") / lines).cast("long")
    rows = _dense(pixels.where("image_id is not null"), axis).withColumn("piece", piece).repartition("image_id", "piece").sortWithinPartitions("image_id", "piece", "y", "x")
    return written(rows.mapInArrow(_write_images(folder), "image_id string, path string, spectra long"), "exports")
