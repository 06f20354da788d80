"""Inventory of file trees, listed and measured on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelflife.session import mounted_path, write_once

# The roots a run covers unless told otherwise.
DEFAULT_ROOTS = [
    "debug",
    "file-history",
    "projects",
    "todos",
    "plans",
    "shell-snapshots",
]

# ``raw`` holds the bytes of a path that is not valid UTF-8, and is what tasks open; ``path`` shows them escaped.
LISTING_SCHEMA = "dir_name string, path string, raw binary, kind string"
INVENTORY_SCHEMA = (
    "dir_name string, path string, size_bytes bigint, mtime timestamp, is_dir boolean, stat_ok boolean"
)
ENTRIES_PER_FILE = 20_000
ROWS_PER_BATCH = 10_000


def root_path(path: str) -> str:
    """A root as the walk spells it: absolute, on a mount, without a slash at the end."""
    path = mounted_path(path)
    if not path.startswith("/"):
        raise ValueError(f"a root must be an absolute path: {path}")
    return path.rstrip("/") or "/"


def rooted(roots: dict[str, str]) -> dict[str, str]:
    return {name: root_path(path) for name, path in roots.items()}


def roots_below(base: str, names: list[str] | None = None) -> dict[str, str]:
    """Root names and their paths below a base folder that every executor sees."""
    base = mounted_path(base).rstrip("/")
    return {name: f"{base}/{name}" for name in names or DEFAULT_ROOTS}


def _list_folders(rows_per_batch: int):
    """Entries directly in each folder: folders to descend into and files, without measuring them.

    A folder that is gone lists nothing, one that may not be listed comes back as blocked; any other failure
    (a lost mount, a broken disk) fails the task, since the walk would not be whole.
    """

    def run(batches):
        import os

        import pandas as pd

        columns = ["dir_name", "path", "raw", "kind"]

        def named(path):
            raw = os.fsencode(path)
            try:
                return raw.decode("utf-8"), None
            except UnicodeDecodeError:
                return raw.decode("utf-8", "backslashreplace"), raw

        for folders in batches:
            rows = []
            for dir_name, folder, raw in zip(folders["dir_name"], folders["path"], folders["raw"]):
                try:
                    entries = os.scandir(folder if raw is None else raw)
                except (FileNotFoundError, NotADirectoryError):
                    continue
                except PermissionError:
                    rows.append((dir_name, folder, raw, "blocked"))
                    continue
                with entries:
                    for entry in entries:
                        try:
                            if entry.is_dir(follow_symlinks=False):
                                kind = "dir"
                            elif entry.is_file():
                                kind = "file"
                            else:
                                continue
                        except FileNotFoundError:
                            continue
                        except PermissionError:
                            kind = "file"
                        rows.append((dir_name, *named(entry.path), kind))
                        if len(rows) >= rows_per_batch:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            yield pd.DataFrame(rows, columns=columns)

    return run


def _measure():
    """Size and time of each listed path. A file gone since the listing is dropped, one that cannot be
    read stays without size and time."""

    def run(batches):
        import os

        for entries in batches:
            sizes, times, keep, readable = [], [], [], []
            for path, raw, kind in zip(entries["path"], entries["raw"], entries["kind"]):
                size = micros = None
                present, known = True, kind != "blocked"
                try:
                    if known:
                        found = os.stat(path if raw is None else raw)
                        size, micros = found.st_size, found.st_mtime_ns // 1000
                except OSError as problem:
                    present, known = not isinstance(problem, FileNotFoundError), False
                sizes.append(size if kind == "file" else None)
                times.append(micros)
                keep.append(present)
                readable.append(known)
            out = entries[["dir_name", "path", "raw"]].copy()
            out["size_bytes"] = _nullable(sizes)
            out["mtime_micros"] = _nullable(times)
            out["is_dir"] = entries["kind"] != "file"
            out["stat_ok"] = readable
            yield out[keep]

    def _nullable(values):
        import pandas as pd

        return pd.array(values, dtype="Int64")

    return run


def existing_roots(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """The roots that are there, as ``(dir_name, path)``; missing ones are left out, not an error."""

    def present(batches):
        import os

        for pdf in batches:
            yield pdf[[os.path.isdir(p) for p in pdf["path"]]]

    wanted = spark.createDataFrame(list(rooted(roots).items()), "dir_name string, path string")
    return wanted.mapInPandas(present, wanted.schema)


def walk_inventory(spark: SparkSession, roots: dict[str, str], run_dir: str) -> DataFrame:
    """Every file and folder below the roots, with size and time: the inventory schema.

    The trees are walked one level per job. Each level's folders are spread over the executors, and its
    listing is written below ``run_dir`` before the next level reads it, so neither the driver nor a
    single task ever holds a subtree, however lopsided the tree. Measuring, the slow call per file, is a
    separate pass over the written listing, whose files of bounded row count spread the entries evenly
    without a shuffle, also those of one giant flat folder. Hidden names, empty files and links to files
    count; links to folders are not followed. A missing root lists nothing. A path that is not valid UTF-8
    is listed with its bytes escaped, and has them in ``raw``. A folder that may not be listed is there with
    ``stat_ok`` false, a root as well.
    """
    roots = rooted(roots)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame(
        [(name, path, None) for name, path in roots.items()], "dir_name string, path string, raw binary"
    )
    level, known = 0, len(roots)
    while known:
        listing = write_once(
            folders.repartition(min(tasks, known)).mapInPandas(_list_folders(ROWS_PER_BATCH), LISTING_SCHEMA),
            f"{run_dir}/listing/level={level}",
            maxRecordsPerFile=ENTRIES_PER_FILE,
        )
        folders = listing.where(F.col("kind") == "dir").select("dir_name", "path", "raw")
        level, known = level + 1, folders.count()
    entries = spark.read.schema(LISTING_SCHEMA).parquet(f"{run_dir}/listing").drop("level")
    blocked = entries.where(F.col("kind") == "blocked")
    if not blocked.isEmpty():
        twice = blocked.select("dir_name", "path", F.lit("dir").alias("kind"))
        entries = entries.join(twice, ["dir_name", "path", "kind"], "left_anti").select(entries.columns)
    measured = entries.mapInPandas(
        _measure(),
        "dir_name string, path string, raw binary, size_bytes bigint, mtime_micros bigint, is_dir boolean, stat_ok boolean",
    )
    return write_once(
        measured.select(
            "dir_name",
            "path",
            "size_bytes",
            F.timestamp_micros("mtime_micros").alias("mtime"),
            "is_dir",
            "stat_ok",
            "raw",
        ),
        f"{run_dir}/inventory",
    )
