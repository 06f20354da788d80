"""File trees as a Spark data source: ``spark.read.format("file_inventory")``, also from SQL.

Rows have the columns of :func:`shelflife.sources.tree.walk_inventory`. Options: ``roots``, a JSON object of root names and
absolute paths on a mount every executor sees, or ``base``, a folder that holds the default roots; ``partitions``, how
many parts a read has at least, where the tree allows it.

Planning lists folders from the roots down, breadth first, until there are enough parts, and at most ``PLANNED_FOLDERS`` of
them. A folder listed there is read in parts of ``ENTRIES`` names each, dealt by a checksum of the name, so one giant flat
folder is measured by several tasks; a folder not listed there is one part with all below it. For trees that are
deep and lopsided as well, :func:`walk_inventory` deals every level anew.

Bounds on ``mtime`` and ``size_bytes``, and tests of ``dir_name`` and ``is_dir``, are taken from the query if
``spark.sql.python.filterPushdown.enabled`` is on: roots that cannot match are not listed, entries that cannot match
leave the task that listed them, and folders are not measured if only files are asked for.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    Not,
)

from shelflife.sources.tree import INVENTORY_SCHEMA, roots_below, rooted

NAME = "file_inventory"
PARTITIONS = 64
PLANNED_FOLDERS = 10_000
ENTRIES = 20_000
ROWS = 10_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)

#: A folder itself, one entry of it, and what stat tells: bytes, microseconds, readable.
Entry = tuple[bytes, bool]


@dataclass
class Part(InputPartition):
    """The entries of a folder whose checksum falls to ``share`` of ``shares``; with all below them if ``deep``."""

    dir_name: str
    folder: bytes
    shares: int = 1
    share: int = 0
    deep: bool = False
    top: bool = False


def entries_of(folder: bytes) -> list[Entry] | None:
    """Paths directly in a folder and whether each is a folder; none if it is gone, None if it may not be listed."""
    try:
        with os.scandir(folder) as found:
            out = []
            for entry in found:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        out.append((entry.path, True))
                    elif entry.is_file():
                        out.append((entry.path, False))
                except FileNotFoundError:
                    continue
                except PermissionError:
                    out.append((entry.path, False))
            return out
    except (FileNotFoundError, NotADirectoryError):
        return []
    except PermissionError:
        return None


def planned(roots: dict[str, str], wanted: int) -> list[Part]:
    """The parts of a read, from folders listed breadth first."""
    todo = deque((name, os.fsencode(path), True) for name, path in roots.items())
    parts: list[Part] = []
    listed = 0
    while todo and listed < PLANNED_FOLDERS and len(todo) + len(parts) < wanted:
        name, folder, top = todo.popleft()
        found, listed = entries_of(folder), listed + 1
        shares = max(1, -(-len(found or []) // ENTRIES))
        parts += [Part(name, folder, shares, k, top=top) for k in range(shares)]
        todo.extend((name, path, False) for path, is_dir in found or [] if is_dir)
    return parts + [Part(name, folder, deep=True, top=top) for name, folder, top in todo]


class Bounds:
    """The filters of a query that are applied while listing."""

    COMPARE = {
        LessThan: lambda a, b: a < b,
        LessThanOrEqual: lambda a, b: a <= b,
        GreaterThan: lambda a, b: a > b,
        GreaterThanOrEqual: lambda a, b: a >= b,
        EqualTo: lambda a, b: a == b,
        In: lambda a, b: a in b,
    }
    COLUMNS = ("dir_name", "size_bytes", "mtime", "is_dir")

    def __init__(self):
        self.tests: list[tuple[str, type, object]] = []

    def take(self, wanted: Filter) -> bool:
        """Whether a filter can be applied here; if so it is from now on."""
        negated = isinstance(wanted, Not)
        inner = wanted.child if negated else wanted
        if len(inner.attribute) != 1 or inner.attribute[0] not in self.COLUMNS:
            return False
        column = inner.attribute[0]
        if isinstance(inner, IsNotNull) and not negated:
            self.tests.append((column, IsNotNull, None))
        elif isinstance(inner, EqualTo) and column == "is_dir":
            self.tests.append((column, EqualTo, inner.value is not negated))
        elif type(inner) in self.COMPARE and not negated:
            value = inner.value
            if column == "mtime":
                value = tuple(map(_micros, value)) if isinstance(inner, In) else _micros(value)
            self.tests.append((column, type(inner), value))
        else:
            return False
        return True

    def hold(self, column: str, value) -> bool:
        """Whether a value passes the filters of its column; an unknown one passes none."""
        tests = [t for t in self.tests if t[0] == column]
        return not tests or value is not None and all(kind is IsNotNull or self.COMPARE[kind](value, other) for _, kind, other in tests)


def _micros(at: dt.datetime) -> int:
    at = at if at.tzinfo else at.astimezone()
    return (at - EPOCH) // dt.timedelta(microseconds=1)


class InventoryReader(DataSourceReader):
    def __init__(self, options):
        roots = json.loads(options["roots"]) if "roots" in options else roots_below(options["base"])
        self.roots, self.wanted, self.bounds = rooted(roots), int(options.get("partitions", PARTITIONS)), Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for wanted in filters:
            if not (hasattr(wanted, "attribute") or isinstance(wanted, Not) and hasattr(wanted.child, "attribute")) or not self.bounds.take(wanted):
                yield wanted

    def partitions(self) -> list[Part]:
        return planned({n: p for n, p in self.roots.items() if self.bounds.hold("dir_name", n)}, self.wanted)

    def read(self, part: Part):
        import pyarrow as pa

        schema = pa.schema(
            [("dir_name", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))]
            + [("is_dir", pa.bool_()), ("stat_ok", pa.bool_()), ("raw", pa.binary())]
        )
        rows = []
        for row in self._rows(part):
            rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def _rows(self, part: Part) -> Iterator[tuple]:
        """Rows of a part that pass the filters. What is blocked has no size and time; what is gone has no row."""
        todo = [(part.folder, part.top)]
        while todo:
            folder, top = todo.pop()
            found = entries_of(folder)
            if found is None:  # a folder's own row comes with its parent's entries, but for a root
                if top and part.share == 0:
                    yield from self._row(part.dir_name, folder, True)
                continue
            for path, is_dir in found:
                if part.shares > 1 and zlib.crc32(path) % part.shares != part.share:
                    continue
                if is_dir and part.deep:
                    todo.append((path, False))
                yield from self._row(part.dir_name, path, is_dir)

    def _row(self, dir_name: str, path: bytes, is_dir: bool) -> Iterator[tuple]:
        if not (self.bounds.hold("is_dir", is_dir) and self.bounds.hold("dir_name", dir_name)):
            return
        size = micros = None
        readable = not is_dir or os.access(path, os.R_OK | os.X_OK)
        if readable:
            try:
                found = os.stat(path)
                size, micros = None if is_dir else found.st_size, found.st_mtime_ns // 1000
            except FileNotFoundError:
                return
            except OSError:
                readable = False
        if self.bounds.hold("size_bytes", size) and self.bounds.hold("mtime", micros):
            try:
                yield dir_name, path.decode("utf-8"), size, micros, is_dir, readable, None
            except UnicodeDecodeError:
                yield dir_name, path.decode("utf-8", "backslashreplace"), size, micros, is_dir, readable, path


class InventorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"{INVENTORY_SCHEMA}, raw binary"

    def reader(self, schema) -> InventoryReader:
        return InventoryReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, and let it have a query's filters."""
    spark.dataSource.register(InventorySource)
    spark.conf.set(PUSHDOWN, "true")
