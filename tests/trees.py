from __future__ import annotations

import datetime as dt
import os

AS_OF = dt.datetime(2025, 6, 15, 12, 0, 0)


def put(path, content="", hours_old=0.0):
    """A file written ``hours_old`` hours before AS_OF."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    touch(path, hours_old)
    return path


def touch(path, hours_old):
    at = AS_OF.replace(tzinfo=dt.timezone.utc) - dt.timedelta(hours=hours_old)
    micros = round(at.timestamp() * 1_000_000)
    os.utime(path, ns=(micros * 1000, micros * 1000))
