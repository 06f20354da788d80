"""Text of files to be scanned."""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame, functions as F

from shelflife.sources.tables import files_only

SPLIT_BYTES = 16 * 1024 * 1024
#: Bytes a match may cover together with what its pattern looks at around it.
SPAN_BYTES = 1024 * 1024
TASK_BYTES = 1024 * 1024 * 1024
#: Text, as it lies in memory, that a task holds before it hands it on; converting it takes several times as much.
BATCH_BYTES = 1024 * 1024
#: What a row counts besides its text.
ROW_BYTES = 512
CONTENT_SCHEMA = "dir_name string, item string, part bigint, text string, own_from int, own_to int, error string"
COLUMNS = [field.split()[0] for field in CONTENT_SCHEMA.split(", ")]


def _read_window(path, part: int, split_bytes: int, span_bytes: int, parts: int = 1) -> tuple[str, int, int]:
    """The text of some parts with its surroundings, and where in it (code points) the parts lie.

    Cuts move forward to the next first byte of a character, in the same way for both parts they lie between.
    """
    start, stop = part * split_bytes, (part + parts) * split_bytes
    low = max(0, start - span_bytes)
    with open(path, "rb") as stream:
        stream.seek(low)
        data = stream.read(stop + span_bytes - low)

    def cut(at):
        at = min(at - low, len(data))
        for _ in range(3):
            if 0 < at < len(data) and data[at] & 0xC0 == 0x80:
                at += 1
        return at

    texts = [data[a:b].decode("utf-8", "replace") for a, b in ((cut(low), cut(start)), (cut(start), cut(stop)), (cut(stop), len(data)))]
    # A match may also stand at the very end of the file.
    end = len(texts[0]) + len(texts[1]) + (cut(stop) == len(data))
    return "".join(texts), len(texts[0]), end


def _read_parts(split_bytes: int | None, span_bytes: int, batch_bytes: int, carry: tuple[str, ...] = ()):
    """Texts of the given parts; of ``parts`` parts from each on where that is named in ``carry``."""

    def read(path, part, parts):
        if split_bytes is not None:
            return _read_window(path, part, split_bytes, span_bytes, parts)
        with open(path, "rb") as stream:
            text = stream.read().decode("utf-8", "replace")
        return text, 0, len(text) + 1

    def run(batches):
        import pandas as pd

        rows, held, columns = [], 0, [*COLUMNS, *carry]
        for pdf in batches:
            parts = pdf["parts"] if "parts" in carry else [1] * len(pdf)
            for dir_name, item, raw, part, count, *kept in zip(pdf["dir_name"], pdf["item"], pdf["raw"], pdf["part"], parts, *(pdf[c] for c in carry)):
                try:
                    text, own_from, own_to = read(item if raw is None else raw, int(part), int(count))
                except (OSError, MemoryError) as problem:
                    text, own_from, own_to, error = None, 0, 0, type(problem).__name__
                else:
                    error = None if len(text) < 2**31 - 64 else "too large for one text"
                    if error:
                        text, own_from, own_to = None, 0, 0
                rows.append((dir_name, item, int(part), text, own_from, own_to, error, *kept))
                held += ROW_BYTES + sys.getsizeof(text)
                if held >= batch_bytes:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    return run


def file_content(inventory: DataFrame, split_bytes: int | None = SPLIT_BYTES, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """Text of every file of an inventory, as UTF-8 with invalid bytes replaced.

    A file is read in parts of ``split_bytes`` by several tasks. A part's text also holds the ``span_bytes``
    before and after it, and ``own_from`` and ``own_to`` say which code points are the part's own: a match
    belongs to the part it starts in, and what it needs to be recognised is in the text of that part, wherever
    the cuts fall and whether the file has line breaks or not. Where a search stands when it reaches the part is for
    the search to settle. ``split_bytes=None`` gives one text per file.
    A file that cannot be read has a row with ``error`` and no text. Only paths are shuffled, into tasks of
    about ``TASK_BYTES`` of text each.
    """
    span_bytes = max(span_bytes, 8)
    files = files_only(inventory).where(F.col("stat_ok") & (F.col("size_bytes") > 0))
    raw = F.col("raw") if "raw" in inventory.columns else F.lit(None).cast("binary")
    last = F.lit(0).cast("bigint") if split_bytes is None else F.floor((F.col("size_bytes") - 1) / split_bytes)
    zero = F.lit(0).cast("bigint")
    found = files.agg(
        F.coalesce(F.sum(last + 1), zero).alias("ranges"), F.coalesce(F.sum("size_bytes"), zero).alias("bytes")
    ).first()
    spread = int(inventory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(spread, found["ranges"]), math.ceil(found["bytes"] / TASK_BYTES), 1)
    ranges = files.select(
        "dir_name",
        F.col("path").alias("item"),
        raw.alias("raw"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"),
    )
    return ranges.repartition(tasks).mapInPandas(_read_parts(split_bytes, span_bytes, BATCH_BYTES), CONTENT_SCHEMA)


def ranges_content(ranges: DataFrame, split_bytes: int, span_bytes: int) -> DataFrame:
    """Text of ranges (dir_name, item, raw, part, parts): ``parts`` parts of a file from ``part`` on, as one text.

    The columns are those of :func:`file_content` and all further ones of ``ranges``.
    """
    extra = [f for f in ranges.schema if f.name not in ("dir_name", "item", "raw", "part")]
    schema = ", ".join([CONTENT_SCHEMA, *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])
    tasks = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = _read_parts(split_bytes, max(span_bytes, 8), BATCH_BYTES, tuple(f.name for f in extra))
    return ranges.repartition(tasks).mapInPandas(read, schema)
