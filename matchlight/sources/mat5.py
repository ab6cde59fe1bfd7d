"""MAT level 5 files: a reader and a writer for numeric, text, cell, struct and sparse arrays, and a Spark data source.

As a table a file is (name, path, row, col, value, text): one row a cell. Cells of a
cell array carry their place in path. The format is the public level 5 layout: tagged
elements, padded to 8 bytes, optionally deflated.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the format: element types by number, and array classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
COMPRESSED, MATRIX, UTF8 = 15, 14, 16
CELL, STRUCT, OBJECT, CHAR, SPARSE, DOUBLE, SINGLE = 1, 2, 3, 4, 5, 6, 7
INTEGERS = {8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}


def _elements(data: bytes):
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:
            size, kind = kind >> 16, kind & 0xFFFF
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def _numbers(kind: int, body: bytes) -> np.ndarray:
    return np.frombuffer(body, "<" + TYPES[kind])


def _array(body: bytes):
    parts = list(_elements(body))
    if not parts:
        return "", np.zeros((0, 0))
    flags, dims, name = struct.unpack("<I", parts[0][1][:4])[0], tuple(_numbers(*parts[1])), parts[2][1].decode()
    kind, rest = flags & 255, parts[3:]
    if kind == CELL:
        out = np.empty(len(rest), object)
        for i, (_, b) in enumerate(rest):
            out[i] = _array(b)[1]
        return name, out.reshape(dims, order="F")
    if kind in (STRUCT, OBJECT):
        rest = rest[kind == OBJECT :]
        width = int(_numbers(*rest[0])[0])
        names = [rest[1][1][i : i + width].rstrip(b"\0").decode() for i in range(0, len(rest[1][1]), width)]
        values = [_array(b)[1] for _, b in rest[2:]]
        n = max(1, int(np.prod(dims)))
        rows = [dict(zip(names, values[i * len(names) : (i + 1) * len(names)])) for i in range(n)] if names else []
        return name, rows[0] if len(rows) == 1 else rows
    if kind == CHAR:
        t, b = rest[0]
        text = b.decode("utf-8" if t in (UTF8, 2, 1) else "utf-16-le")
        return name, text if len(dims) == 2 and dims[0] == 1 else ["".join(text[i :: dims[0]]) for i in range(dims[0])]
    if kind == SPARSE:
        i, j, v = _numbers(*rest[0]), _numbers(*rest[1]), _numbers(*rest[2])
        out = np.zeros(dims)
        for c in range(dims[1]):
            out[i[j[c] : j[c + 1]], c] = v[j[c] : j[c + 1]]
        return name, out
    values = _numbers(*rest[0])
    if flags >> 11 & 1:
        values = values + 1j * _numbers(*rest[1])
    elif kind in INTEGERS:
        values = values.astype(INTEGERS[kind])
    else:
        values = values.astype("f4" if kind == SINGLE else "f8")
    return name, values.reshape(dims, order="F")


def loads(data: bytes) -> dict:
    """Names to arrays, texts, lists and dicts of a file."""
    if len(data) < 128 or data[126:128] != b"IM":
        raise ValueError("not a little-endian level 5 file")
    found = {}
    for kind, body in _elements(data[128:]):
        if kind == COMPRESSED:
            body = next(_elements(zlib.decompress(body)))[1]
        name, value = _array(body)
        found[name] = value
    return found


def _element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)


def _matrix(name: str, value) -> bytes:
    def head(kind: int, dims, more: int = 0) -> bytes:
        return _element(6, struct.pack("<II", kind | more, 0)) + _element(5, np.array(dims, "<i4").tobytes()) + _element(1, name.encode())

    if isinstance(value, str):
        body = head(CHAR, (1, len(value))) + _element(4, value.encode("utf-16-le"))
    elif isinstance(value, dict):
        width = max([len(k) for k in value], default=0) + 1
        names = b"".join(k.encode().ljust(width, b"\0") for k in value)
        body = head(STRUCT, (1, 1)) + _element(5, struct.pack("<i", width)) + _element(1, names) + b"".join(_matrix("", v) for v in value.values())
    elif isinstance(value, (list, tuple)) or isinstance(value, np.ndarray) and value.dtype == object:
        cells = np.asarray(value, object) if isinstance(value, np.ndarray) else np.fromiter(value, object, len(value)).reshape(1, -1)
        body = head(CELL, cells.shape if cells.ndim > 1 else (1, len(cells))) + b"".join(_matrix("", v) for v in cells.ravel(order="F"))
    else:
        a = np.atleast_2d(np.asarray(value))
        flat = lambda x, t: _element({v: k for k, v in TYPES.items()}[t], np.asarray(x, "<" + t).tobytes(order="F"))
        if a.dtype.kind == "c":
            body = head(DOUBLE, a.shape, 1 << 11) + flat(a.real, "f8") + flat(a.imag, "f8")
        elif a.dtype.kind in "iu":
            code = a.dtype.str[1:]
            body = head({v: k for k, v in INTEGERS.items()}[code], a.shape) + flat(a, code)
        elif a.dtype == np.float32:
            body = head(SINGLE, a.shape) + flat(a, "f4")
        else:
            body = head(DOUBLE, a.shape) + flat(a.astype(float), "f8")
    return _element(MATRIX, body)


def sparse(name: str, i: np.ndarray, j: np.ndarray, v: np.ndarray, shape: tuple[int, int]) -> bytes:
    """A sparse array's element from places and values."""
    order = np.lexsort((i, j))
    starts = np.concatenate(([0], np.cumsum(np.bincount(j, minlength=shape[1])))).astype("<i4")
    head = _element(6, struct.pack("<II", SPARSE, max(1, len(v)))) + _element(5, np.array(shape, "<i4").tobytes()) + _element(1, name.encode())
    return _element(MATRIX, head + _element(5, np.asarray(i)[order].astype("<i4").tobytes()) + _element(5, starts.tobytes()) + _element(9, np.asarray(v)[order].astype("<f8").tobytes()))


def dumps(values: dict, compress: bool = True) -> bytes:
    out = io.BytesIO()
    out.write(b"MATLAB 5.0 MAT-file".ljust(116) + bytes(8) + struct.pack("<H", 0x0100) + b"IM")
    for name, value in values.items():
        body = value if isinstance(value, bytes) else _matrix(name, value)
        if compress:
            body = zlib.compress(body)
            body = struct.pack("<II", COMPRESSED, len(body)) + body
        out.write(body)
    return out.getvalue()


SCHEMA = "name string, path string, row int, col int, value double, text string"


def cells(name: str, value, path: str = ""):
    """The rows of a value."""
    if isinstance(value, str):
        yield name, path, 0, 0, None, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from cells(name, v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from cells(name, v, f"{path}({i})")
    elif value.dtype == object:
        for i, v in np.ndenumerate(value):
            yield from cells(name, v, f"{path}{{{','.join(map(str, i))}}}")
    else:
        flat = value.real.reshape(value.shape[0], -1) if value.ndim > 1 else value.real.reshape(1, -1)
        for (i, j), v in np.ndenumerate(flat):
            yield name, path, i, j, float(v), None


class _File(InputPartition):
    def __init__(self, uri: str):
        super().__init__(None)
        self.uri = uri


def _store(uri: str):
    """File system and path of a place; planning runs outside of Spark, so stores are those that Arrow knows. read() takes any store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class Mat5Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.names = set(filter(None, options.get("names", "").split(",")))

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.uri)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        base = self.uri[: len(self.uri) - len(path)] if "://" in self.uri else ""
        return [_File(base + f.path) for f in files if f.is_file]

    def read(self, partition):
        store, path = _store(partition.uri)
        with store.open_input_file(path) as f:
            data = f.read()
        for name, value in loads(data).items():
            if not self.names or name in self.names:
                yield from cells(name, value)


#: Cells that one file takes unless told otherwise.
MAX_CELLS = 10_000_000


class _Part(WriterCommitMessage):
    def __init__(self, rows: list):
        self.rows = rows


class Mat5Writer(DataSourceWriter):
    """Numeric rows (name, row, col, value) to one file at path on commit: a sink for driver-sized arrays such as metrics and codebooks.

    More than maxCells cells (an option, 10 million by default) are refused, in a task as soon as it holds so many, or at the commit.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("maxCells") or options.get("maxcells") or MAX_CELLS)

    def _bounded(self, n: int) -> None:
        if n > self.most:
            raise ValueError(f"more than {self.most} cells for one file; raise maxCells or write a table")

    def write(self, iterator):
        rows = []
        for r in iterator:
            rows.append((r["name"], r["row"], r["col"], r["value"]))
            self._bounded(len(rows))
        return _Part(rows)

    def commit(self, messages):
        self._bounded(sum(len(m.rows) for m in messages))
        arrays: dict = {}
        for m in messages:
            for name, i, j, v in m.rows:
                arrays.setdefault(name, []).append((i, j, v))
        values = {}
        for name, rows in sorted(arrays.items()):
            a = np.zeros((max(r[0] for r in rows) + 1, max(r[1] for r in rows) + 1))
            for i, j, v in rows:
                a[i, j] = v
            values[name] = a
        store, path = _store(self.path)
        with store.open_output_stream(path) as f:
            f.write(dumps(values))


class Mat5DataSource(DataSource):
    @classmethod
    def name(cls):
        return "mat5"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Mat5Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return Mat5Writer(dict(self.options))


def read(spark, path: str, names: str = ""):
    """The cells of all files under path, each file in a task; works on any store."""
    wanted = set(filter(None, names.split(",")))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                rows = [r for name, value in loads(bytes(content)).items() if not wanted or name in wanted for r in cells(name, value)]
                yield pd.DataFrame(rows, columns=["name", "path", "row", "col", "value", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def codebook(table, orientation: str = "rows"):
    """type, word, center from arrays codebook_<TYPE> or <TYPE>; words are rows, or columns."""
    from pyspark.sql import functions as F

    word, place = ("row", "col") if orientation == "rows" else ("col", "row")
    x = table.where("value is not null").groupBy(F.regexp_replace("name", "^codebook_", "").alias("type"), F.col(word).alias("word"))
    return x.agg(F.transform(F.array_sort(F.collect_list(F.struct(place, "value"))), lambda c: c["value"]).alias("center"))
