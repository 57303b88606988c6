"""Sources and sinks of captures: odometry, depth pictures, point clouds, photo folders, documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
IMAGES = r"\.(jpg|jpeg|png|heic|heif)$"
#: A point of a cloud file, 15 bytes.
PLY_POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])


def read_odometry(spark: SparkSession, root: str, name: str = "odometry.csv") -> DataFrame:
    """Frames of captures ``root``/<capture>/odometry.csv (or files of the pattern ``name``): capture_id, frame (the line's number), ts, pose and intrinsics; columns are taken by position.

    A file's lines are numbered within the file by their order; files are read whole for that. One task names what lies below ``root``, and others look through it and read,
    so no listing goes through the driver.
    """
    from .clouds import located

    hidden = lambda path: any(part.startswith(("_", ".")) for part in path.split("/"))

    def tops(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = located(root)
        yield pa.RecordBatch.from_arrays([pa.array([f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory and not hidden(f.base_name)], pa.string())], ["top"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = located(root)
        for batch in batches:
            for top in batch.column("top").to_pylist():
                for found in system.get_file_info(fs.FileSelector(f"{at}/{top}", recursive=True)):
                    if found.type == fs.FileType.File and fnmatchcase(found.base_name, name) and not hidden(found.path[len(at) :].lstrip("/")):
                        with system.open_input_stream(found.path) as file:
                            yield pa.RecordBatch.from_arrays([pa.array([found.path.split("/")[-2]]), pa.array([file.read().decode()])], ["capture_id", "value"])

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = spark.range(1, numPartitions=1).mapInArrow(tops, "top string").repartition(n, "top").mapInArrow(contents, "capture_id string, value string")
    lines = text.select("capture_id", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n")).alias("n", "line")).where("n > 0 and trim(line) <> ''")
    d = lambda i: F.expr(f"try_cast(trim(get(split(line, ','), {i})) AS double)")
    names = {0: "ts", 2: "px", 3: "py", 4: "pz", 5: "qx", 6: "qy", 7: "qz", 8: "qw", 9: "fx", 10: "fy", 11: "cx", 12: "cy"}
    return lines.select("capture_id", (C("n") - 1).cast("long").alias("frame"), *[d(i).alias(name) for i, name in names.items()])


def decode_png(data: bytes) -> np.ndarray:
    """Grey pictures of 8 or 16 bits, without interlacing, as an array."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
        if kind == b"IEND":
            break
    width, height, bits, colour, _, _, interlace = head
    if colour != 0 or bits not in (8, 16) or interlace:
        raise ValueError("only plain grey pictures are read")
    step = bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    if not raw[:, 0].any():  # no row is filtered
        out[:] = raw[:, 1:]
        return out.view(">u2").astype(np.uint16) if bits == 16 else out
    before = np.zeros(width * step, np.int64)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).ravel()
        elif kind == 2:
            line = line + before
        elif kind in (3, 4):
            for i in range(len(line)):
                a = int(line[i - step]) & 255 if i >= step else 0
                b, c = int(before[i]), int(before[i - step]) if i >= step else 0
                if kind == 3:
                    line[i] += (a + b) // 2
                else:
                    e = a + b - c
                    line[i] += min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
                line[i] &= 255
        before = line & 255
        out[y] = before
    return out.view(">u2").astype(np.uint16) if bits == 16 else out


def encode_png(grey: np.ndarray) -> bytes:
    """The inverse of ``decode_png``, unfiltered."""
    bits = grey.dtype.itemsize * 8
    rows = grey.astype(">u2" if bits == 16 else "u1")
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], bits, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


#: Pixels that go on together: those of many small pictures, or of a large one.
TOGETHER = 200_000


@lru_cache(maxsize=16)
def _places(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    row, col = np.indices(shape, dtype=np.int32)
    return row.ravel(), col.ravel()


def _pixels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(held: list[tuple[list[str], np.ndarray]]) -> pd.DataFrame:
        n = [grid.size for _, grid in held]
        said = lambda i: np.repeat(np.array([parts[i] for parts, _ in held], object), n)
        frame = np.repeat(np.array([int(parts[-1].split(".")[0]) for parts, _ in held], np.int64), n)
        row, col = (np.concatenate([_places(grid.shape)[i] for _, grid in held]) for i in (0, 1))
        return pd.DataFrame({"capture_id": said(-3), "kind": said(-2), "frame": frame, "row": row, "col": col, "value": np.concatenate([grid.ravel() for _, grid in held]).astype(np.int32)})

    for pdf in frames:
        held, size = [], 0
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            held.append((path.split("/")[-3:], decode_png(bytes(content))))
            size += held[-1][1].size
            if size >= TOGETHER:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)


def depth_pixels(files: DataFrame) -> DataFrame:
    """Pixels of pictures (path .../<capture>/{depth,confidence}/NNNNNN.png, content): capture_id, frame, row, col, depth (metres, 0: none), conf."""
    px = files.select("path", "content").mapInPandas(_pixels, "capture_id string, kind string, frame long, row int, col int, value int")
    keys = ["capture_id", "frame", "row", "col"]
    return px.groupBy(*keys).agg(F.max(F.when(C("kind") == "depth", (C("value") / 1000).cast("float"))).alias("depth"), F.max(F.when(C("kind") == "confidence", C("value"))).alias("conf"))


def read_depth(spark: SparkSession, root: str) -> DataFrame:
    """``depth_pixels`` of the pictures below ``root``."""
    return depth_pixels(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root))


def ply_bytes(points: pd.DataFrame) -> bytes:
    """A binary cloud file of x, y, z, r, g, b; colours are cut to 0-255 and to whole numbers."""
    out = np.zeros(len(points), PLY_POINT)
    for c in "xyz":
        out[c] = points[c]
    for c in "rgb":
        out[c] = np.clip(points[c], 0, 255).astype(np.uint8)
    names = {"r": "red", "g": "green", "b": "blue"}
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(points)}", *[f"property float {c}" for c in "xyz"], *[f"property uchar {names[c]}" for c in "rgb"], "end_header", ""]
    return "\n".join(head).encode() + out.tobytes()


def parse_ply(data: bytes) -> np.ndarray:
    return np.frombuffer(data, PLY_POINT, offset=data.index(b"end_header\n") + 11)


def to_ply(points: DataFrame, keys: list[str]) -> DataFrame:
    """One cloud file for each group of points, as keys and content; the group must fit one file, as clouds of voxels of one home do."""
    kinds = dict(points.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "content": [ply_bytes(pdf.sort_values(list("xyz")))]})

    return points.select(*keys, *"xyzrgb").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", content binary")


def from_ply(files: DataFrame, keys: list[str]) -> DataFrame:
    """Points of cloud files (keys, content)."""
    kinds = dict(files.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                p = parse_ply(bytes(row.content))
                out = pd.DataFrame({c: p[c].astype(np.float64) for c in "xyzrgb"})
                for k in reversed(keys):
                    out.insert(0, k, getattr(row, k))
                yield out

    return files.select(*keys, "content").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x double, y double, z double, r double, g double, b double")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    return from_ply(spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", True).load(path).select("path", "content"), ["path"])


#: Tags of picture metadata (orientation, its further part, focal length as on 35 mm film) and sizes of its types.
ORIENTATION, FURTHER, FOCAL_35MM = 0x0112, 0x8769, 0xA405
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(data: bytes) -> dict[int, int]:
    """Whole-number tags of a JPEG's metadata, those of the further part too; nothing where there are none or they are broken."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _tags(data[at + 10 : at + 2 + size])
        if data[at + 1] == 0xDA:
            break
        at += 2 + size
    return {}


def _tags(tiff: bytes) -> dict[int, int]:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    number = lambda at, n: int.from_bytes(tiff[at : at + n], order)
    out: dict[int, int] = {}
    parts = [number(4, 4)] if order else []
    for start in parts:  # the first part names the further one
        if start + 2 > len(tiff) or len(parts) > 4:
            break
        for i in range(number(start, 2)):
            at = start + 2 + 12 * i
            kind, count = number(at + 2, 2), number(at + 4, 4)
            if at + 12 <= len(tiff) and kind in (3, 4) and count == 1:
                tag, value = number(at, 2), number(at + 8, TYPE_BYTES[kind])
                out[tag] = value
                if tag == FURTHER:
                    parts.append(value)
    return out


def with_exif(body: bytes, orientation: int | None, focal35: int | None) -> bytes:
    """A JPEG's bytes with metadata that has these two, after the picture's first marker."""
    entry = lambda tag, kind, value: struct.pack("<HHII", tag, kind, 1, value)
    first = ([entry(ORIENTATION, 3, orientation)] if orientation else []) + ([entry(FURTHER, 4, 8 + 2 + 12 * (1 + bool(orientation)) + 4)] if focal35 else [])
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(first)) + b"".join(first) + b"\0\0\0\0"
    if focal35:
        tiff += struct.pack("<H", 1) + entry(FOCAL_35MM, 3, focal35) + b"\0\0\0\0"
    return body[:2] + b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + body[2:]


def _metadata(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        tags = [exif(bytes(x)) if x is not None else {} for x in pdf["head"]]
        focal = [float(t[FOCAL_35MM]) if t.get(FOCAL_35MM) else None for t in tags]
        yield pdf.drop(columns="head").assign(orientation=[t.get(ORIENTATION, 1) for t in tags], focal35=pd.array(focal, dtype="Float64"))


def photos_of(files: DataFrame) -> DataFrame:
    """Photos of files (path .../<room>/<file>, length, content): room, name, path, size, orientation (1: upright), focal35 (null: not said). A picture's head is looked at as far as its own marks say that it goes, wherever in it metadata stand."""
    parts = F.split("path", "/")
    named = files.where(F.lower("path").rlike(IMAGES)).select(F.element_at(parts, -2).alias("room"), F.element_at(parts, -1).alias("name"), "path", C("length").alias("size"), C("content").alias("head"))
    return named.mapInPandas(_metadata, "room string, name string, path string, size long, orientation int, focal35 double")


def list_photos(spark: SparkSession, root: str) -> DataFrame:
    """``photos_of`` the files below ``root``."""
    return photos_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def cap_points(points: DataFrame, most: int, seed: int = 0, keys: tuple[str, ...] = ("ord", "line"), by: list[str] | None = None) -> DataFrame:
    """At most ``most`` points for a viewer, of each group ``by`` if given: those of the smallest hashes (MD5 of their keys and the seed), so that runs agree."""
    order = [F.md5(F.concat_ws(":", *[C(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary")), *[C(k) for k in keys]]
    if by is None:
        return points.orderBy(*order).limit(most)
    return points.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(C("place") <= most).drop("place")


def plan_svg(cells: DataFrame) -> DataFrame:
    """A picture of each capture's rooms as SVG text: capture_id, svg. Runs of cells in a row are one rectangle."""
    w = Window.partitionBy("capture_id", "row").orderBy("col")
    new = F.coalesce(((C("col") != F.lag("col").over(w) + 1) | (C("room_id") != F.lag("room_id").over(w))).cast("int"), F.lit(1))
    runs = cells.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("capture_id", "row", "run", "room_id").agg(F.min("col").alias("a"), F.count("*").alias("n"))
    rect = F.format_string('<rect x="%d" y="%d" width="%d" height="1" class="r%d"/>', "a", "row", "n", "room_id")
    rows = runs.groupBy("capture_id").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("row", "a", rect.alias("r")))), lambda x: x["r"])).alias("body"))
    return rows.select("capture_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), "body", F.lit("</svg>")).alias("svg"))
