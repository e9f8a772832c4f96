"""CSV records as pandas reads them, from splits of any size.

A quoted field may hold separators, doubled quotes and line breaks, so a split
of a file can begin inside one. Spark's line reader cuts the files into splits;
two passes over its lines find the records:

1. :func:`survey`, one map-only job. What a stretch of lines does to the state
   "inside a quoted field" is a function of the state before it. Each task
   follows both states, until they agree, and returns one row per split: where
   either of them ends, and the header if the split begins its file. Chaining
   these from a file's first split tells which splits begin inside a field.
2. :func:`records`, the scan itself. Each task starts in the right state, cuts
   its lines into records and parses them with Python's ``csv`` (C code), whose
   rules are those of pandas: a quote counts at the start of a field only, text
   behind a closing quote belongs to the field. A split that the survey has not
   seen (files or settings changed in between) fails the read.

A record that lies over a border of splits is read by a second branch that looks
at such files only, and put together from its pieces. The driver holds one small
row per split, as Spark does itself.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Holds the text of a record with more fields than the header, or without an end.
CORRUPT = "_corrupt"
#: A longer record is taken for a quote that was never closed, and fails the read.
MAX_RECORD = 16 << 20
BOM = b"\xef\xbb\xbf"


class MalformedFile(ValueError):
    pass


# ----------------------------------------------------------------------------- quotes

class Quotes:
    """Whether a line leaves a quoted field open. Lines end at ``\\n``; a lone
    ``\\r`` outside quotes also ends a record, so it separates fields here."""

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        inside = rb'(?:[^"]++|"")*+'
        field = rb'(?:"' + inside + rb'"[^' + s + rb'\r]*+|[^"' + s + rb'\r][^' + s + rb'\r]*+|)'
        rest = rb'(?:' + field + rb'[' + s + rb'\r])*+"' + inside + rb'\Z'
        self.from_outside = re.compile(rest).match
        self.from_inside = re.compile(inside + rb'(?:\Z|"[^' + s + rb'\r]*+[' + s + rb'\r]' + rest + rb')').match

    def after(self, line: bytes, inside: bool) -> bool:
        return (self.from_inside if inside else self.from_outside)(line) is not None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int, np.ndarray]]:
    """The splits in a batch of (file, start, value): their key, first and last
    row, and which of the rows hold a quote."""
    file, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    quoted = np.flatnonzero(pc.match_substring(batch.column(2), '"').to_numpy(zero_copy_only=False))
    edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield (int(file[a]), int(start[a])), a, b, quoted[np.searchsorted(quoted, a):np.searchsorted(quoted, b)]


def _lines(spark: SparkSession, path) -> DataFrame:
    """``file`` (a number for its path), ``start`` (of the split), ``value`` (bytes
    of a line), in the order of the file within a task."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(_file_number().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _file_number():
    return F.xxhash64("_metadata.file_path")


# ----------------------------------------------------------------------------- first pass

def _survey(sep: str):
    quotes = Quotes(sep)

    def run(batches):
        key, states, header = None, [False, True], None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([states[0]]), pa.array([states[1]]), pa.array([header], pa.binary())],
                names=["file", "start", "from_outside", "from_inside", "header"])

        for batch in batches:
            for own, a, b, quoted in _runs(batch):
                if own != key:
                    if key is not None:
                        yield row()
                    key, states, header = own, [False, True], None
                if key[1] == 0 and header is None:
                    for i in range(a, b):
                        line = batch.column(2)[i].as_py()
                        line = (line.removeprefix(BOM) if i == a else line).rstrip(b"\r")
                        if line:
                            header = line
                            break
                for i in quoted.tolist():
                    line = batch.column(2)[i].as_py()
                    if key[1] == 0 and i == a:
                        line = line.removeprefix(BOM)
                    out = quotes.after(line, states[0])
                    states = [out, out if states[1] == states[0] else quotes.after(line, states[1])]
        if key is not None:
            yield row()
    return run


class Survey:
    """What the first pass says of the files: their columns and where splits begin
    inside a quoted field."""

    def __init__(self, spark: SparkSession, path, sep: str, charset: str):
        rows = _lines(spark, path).mapInArrow(
            _survey(sep), "file bigint, start bigint, from_outside boolean, from_inside boolean, header binary").collect()
        quotes = Quotes(sep)
        self.columns: list[str] = []
        #: files whose columns stand in another order: where each column is
        self.orders: dict[int, list[int]] = {}
        names: dict[int, tuple[str, ...]] = {}
        for r in rows:
            if r.header is None:
                continue
            header = bytes(r.header)
            if quotes.after(header, False):
                raise MalformedFile(f"{_path_of(spark, path, r.file)}: a quoted column name goes over the line's end: {header[:200]!r}")
            names[r.file] = tuple(_names(header, sep, charset))
        if names:
            self.columns = list(max(Counter(names.values()).items(), key=lambda x: (x[1], x[0]))[0])
        for file, own in names.items():
            if len(set(own)) < len(own) or set(own) != set(self.columns):
                raise MalformedFile(f"{_path_of(spark, path, file)}: columns {list(own)}, other files have {self.columns}")
            if list(own) != self.columns:
                self.orders[file] = [own.index(c) for c in self.columns]
        #: splits that begin inside a field, and splits that end inside one that goes on in the next
        self.begin_inside: set[tuple[int, int]] = set()
        self.end_inside: set[tuple[int, int]] = set()
        self.splits = np.sort(np.array([hash((r.file, r.start)) for r in rows], np.int64))
        before, state = None, False
        for r in sorted(rows, key=lambda r: (r.file, r.start)):
            if before is None or before.file != r.file:
                state = False
            elif state:
                self.begin_inside.add((r.file, r.start))
                self.end_inside.add((before.file, before.start))
            state, before = r.from_inside if state else r.from_outside, r


def _names(header: bytes, sep: str, charset: str) -> list[str]:
    text = io.StringIO(header.decode("iso-8859-1"), newline="")
    raw = next((r for r in csv.reader(text, delimiter=sep) if r), [])
    return [_utf8_or_latin1(x) if charset == "auto" else x.encode("iso-8859-1").decode(charset, errors="replace") for x in raw]


def _path_of(spark: SparkSession, path, file: int) -> str:
    found = spark.read.text(path).where(_file_number() == file).select("_metadata.file_path").first()
    return found[0] if found else str(path)


# ----------------------------------------------------------------------------- parsing

def _utf8_or_latin1(value: str) -> str:
    """A value read as ISO-8859-1; its bytes as UTF-8 where they are valid."""
    if value.isascii():
        return value
    try:
        return value.encode("iso-8859-1").decode("utf-8")
    except UnicodeError:
        return value


class Parser:
    """Lines of whole records -> an Arrow batch of the columns and CORRUPT."""

    def __init__(self, columns: list[str], sep: str, charset: str):
        self.columns, self.sep, self.charset = columns, sep, charset
        self.schema = pa.schema([(c, pa.string()) for c in [*columns, CORRUPT]])

    def __call__(self, lines: list[bytes], order: list[int] | None = None, skip: bool = False) -> pa.RecordBatch:
        csv.field_size_limit(MAX_RECORD)
        whole, fix = b"\n".join(lines), None
        if self.charset == "auto":
            try:
                text = whole.decode("utf-8")
            except UnicodeError:
                text, fix = whole.decode("iso-8859-1"), _utf8_or_latin1
        else:
            text = whole.decode(self.charset, errors="replace")
        # a line by itself is blank; only the first line of a file is a header
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=self.sep) if r][skip:]
        n = len(self.columns)
        good = [r if len(r) == n else r + [None] * (n - len(r)) for r in rows if len(r) <= n]
        bad = [self.sep.join(r) for r in rows if len(r) > n]
        columns = list(zip(*good)) or [()] * n
        if order:
            columns = [columns[i] for i in order]
        if fix:
            columns = [[fix(v) if v else None for v in c] for c in columns]
        else:
            columns = [[v or None for v in c] for c in columns]
        arrays = [pa.array([*c, *[None] * len(bad)], pa.string()) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([None] * len(good) + bad, pa.string())], schema=self.schema)

    def unended(self, lines: list[bytes]) -> pa.RecordBatch:
        text = pa.array([b"\n".join(lines).decode("utf-8", errors="replace")], pa.string())
        return pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.string())] * len(self.columns), text], schema=self.schema)


def _too_long(lines: list[bytes]) -> None:
    if sum(map(len, lines)) > MAX_RECORD:
        raise MalformedFile(f"a quoted field is not closed within {MAX_RECORD} bytes; it begins with {lines[0][:200]!r}")


def _seen(splits: np.ndarray, key: tuple[int, int]) -> None:
    at = np.searchsorted(splits, hash(key))
    if at == len(splits) or splits[at] != hash(key):
        raise RuntimeError("the files were cut into other splits than before (files or settings changed since read_csv); read them again")


def _cut(batches, quotes: Quotes, begin_inside, splits: np.ndarray):
    """Lines -> (split, what, lines): ``"records"`` whole records; ``"head"`` the
    lines of a split that end a record of an earlier one, ``"through"`` all of
    them when they do not; ``"tail"`` the lines after its last whole record."""
    key, state, head, pending = None, False, False, []
    for batch in batches:
        for own, a, b, quoted in _runs(batch):
            if own != key:
                if pending:
                    yield key, "through" if head else "tail", pending
                _seen(splits, own)
                key, state, pending = own, own in begin_inside, []
                head, first = state, True
            else:
                first = False
            lines = batch.column(2).slice(a, b - a).to_pylist()
            if first and key[1] == 0:
                lines[0] = lines[0].removeprefix(BOM)
            inside = np.empty(len(lines), bool)
            done = 0
            for i in (quoted - a).tolist():
                inside[done:i] = state
                state = inside[i] = quotes.after(lines[i], state)
                done = i + 1
            inside[done:] = state
            ends = np.flatnonzero(~inside)
            if not len(ends):
                pending += lines
                _too_long(pending)
                continue
            begin, end = 0, int(ends[-1]) + 1
            if head:
                begin, head = int(ends[0]) + 1, False
                yield key, "head", pending + lines[:begin]
                pending = []
            if begin < end:
                yield key, "records", pending + lines[begin:end]
            pending = lines[end:]
    if pending:
        yield key, "through" if head else "tail", pending


def records(spark: SparkSession, path, sep: str, charset: str) -> DataFrame:
    """All files under ``path``, columns matched by name, plus CORRUPT, which holds
    the text of a record with more fields than the header or without an end; its
    other columns are null. ``charset``: a Python codec that extends ASCII, or
    ``auto`` (each value UTF-8 where its bytes are valid, else ISO-8859-1)."""
    if charset != "auto" and b';"\r\n'.decode(charset) != ';"\r\n':
        raise ValueError(f"{charset}: line ends and quotes must be single bytes")
    found = Survey(spark, path, sep, charset)
    if not found.columns:
        return spark.createDataFrame([], T.StructType([T.StructField(CORRUPT, T.StringType())]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*found.columns, CORRUPT]])
    quotes, parser = Quotes(sep), Parser(found.columns, sep, charset)
    shared = spark.sparkContext.broadcast((found.begin_inside, found.end_inside, found.orders, found.splits))

    def whole(batches):
        begin_inside, end_inside, orders, splits = shared.value
        headed = None
        for key, what, lines in _cut(batches, quotes, begin_inside, splits):
            if what == "records":
                skip = key[1] == 0 and headed != key and any(x.strip(b"\r") for x in lines)
                headed = key if skip else headed
                yield parser(lines, orders.get(key[0]), skip)
            elif what == "tail" and key not in end_inside:
                yield parser.unended(lines)

    lines = _lines(spark, path)
    out = lines.mapInArrow(whole, schema)
    if not found.begin_inside:
        return out
    return out.unionByName(_over_borders(spark, path, found, shared, quotes, parser, schema))


def _over_borders(spark, path, found: Survey, shared, quotes, parser, schema) -> DataFrame:
    """The records that begin in one split and end in a later one."""
    def pieces(batches):
        begin_inside, end_inside, _, splits = shared.value
        for key, what, lines in _cut(batches, quotes, begin_inside, splits):
            if what in ("head", "through") or what == "tail" and key in end_inside:
                yield pa.RecordBatch.from_pylist([{"file": key[0], "start": key[1], "tail": what == "tail", "text": b"\n".join(lines)}],
                                                 schema=pa.schema([("file", pa.int64()), ("start", pa.int64()), ("tail", pa.bool_()), ("text", pa.binary())]))

    def parse(batches):
        orders = shared.value[2]
        for batch in batches:
            for file, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _too_long(texts)
                text = b"\n".join(texts)
                inside = False
                for line in text.split(b"\n"):
                    inside = quotes.after(line, inside)
                yield parser.unended(texts) if inside else parser(texts, orders.get(file))

    # filtered behind the scan: with fewer files it would be cut into other splits
    near = [f ^ s for f, s in found.begin_inside | found.end_inside]
    cut = _lines(spark, path).where(F.col("file").bitwiseXOR(F.col("start")).isin(near)).mapInArrow(
        pieces, "file bigint, start bigint, tail boolean, text binary")
    # in a split the head comes first; a tail begins a record
    order = Window.partitionBy("file").orderBy("start", F.col("tail"))
    numbered = cut.withColumn("record", F.sum(F.col("tail").cast("int")).over(order))
    joined = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "tail", "text"))).alias("p"))
    return joined.select("file", F.transform("p", lambda x: x["text"]).alias("texts")).mapInArrow(parse, schema)
