"""Incremental ingest: freshness, content hashes, charset normalisation, manifest, snapshots.

``python -m lexispark.sources.ingest SOURCE_URL_OR_DIR TARGET_DIR`` runs it once.
"""

from __future__ import annotations

import hashlib
import json
import logging
import sys
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import DATASETS
from .tsv import C1

#: Hours after which a file is looked at again, and seconds that a transfer may take.
FRESH_HOURS, TIMEOUT = 24, 30
MANIFEST = "meta.json"
log = logging.getLogger(__name__)


def is_due(checked: Column, downloaded: Column, now: Column, hours: int = FRESH_HOURS) -> Column:
    """Whether a file is due for a check: no or unreadable date, or an age of ``hours`` at least. Dates are text."""
    seen = F.try_to_timestamp(F.coalesce(F.when(checked != "", checked), downloaded))
    return F.coalesce(seen <= now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))


def changed(new: DataFrame, manifest: DataFrame, key: str = "filename") -> DataFrame:
    """``new (filename, hash)`` against the manifest: rows with ``status`` new, changed or same."""
    old = manifest.select(F.col(key), F.col("hash").alias("old_hash"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("old_hash")), "same").otherwise("changed")
    return new.join(old, key, "left").withColumn("status", status).drop("known")


def digests(files: DataFrame) -> DataFrame:
    """SHA-256 of raw bytes of a ``binaryFile`` frame."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("hash"))


def load_manifest(folder: Path) -> dict:
    try:
        return json.loads((folder / MANIFEST).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def save_manifest(folder: Path, manifest: dict) -> None:
    own = folder / (MANIFEST + ".new")
    own.write_text(json.dumps(manifest, indent=2, ensure_ascii=False), encoding="utf-8")
    own.replace(folder / MANIFEST)


def normalised(raw: bytes) -> tuple[bytes, str]:
    """UTF-8 bytes and the charset found; as ``tsv.decode`` reads them, but for byte-order marks, which stay in UTF-8."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") and len(raw) % 2 == 0:
        return raw.decode("utf-16", "replace").encode(), "utf-16"
    try:
        raw.decode("utf-8")
        return raw, "utf-8"
    except UnicodeDecodeError:
        name = "windows-1252" if any(0x80 <= b < 0xA0 for b in raw) else "iso-8859-1"
        return raw.decode("latin-1").translate({b: c for b, c in C1.items()}).encode(), name


def fetch(source: str, name: str) -> bytes:
    if "://" in source:
        request = urllib.request.Request(f"{source.rstrip('/')}/{name}", headers={"User-Agent": "Mozilla/5.0"})
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            return answer.read()
    return (Path(source) / name).read_bytes()


def _due(entry: dict | None, now: datetime) -> bool:
    try:
        seen = datetime.fromisoformat((entry or {}).get("checkedAt") or (entry or {})["downloadedAt"])
        return now - (seen if seen.tzinfo else seen.replace(tzinfo=UTC)) >= timedelta(hours=FRESH_HOURS)
    except (KeyError, TypeError, ValueError):
        return True


def refresh(source: str, target: str, now: datetime | None = None, get: Callable[[str, str], bytes] = fetch) -> dict[str, str]:
    """Bring the files of all enabled datasets up to date; status by file. A file that fails keeps its old version."""
    folder, now = Path(target), now or datetime.now(UTC)
    folder.mkdir(parents=True, exist_ok=True)
    manifest, status = load_manifest(folder), {}
    for name in (d.file for d in DATASETS.values() if d.file and d.enabled):
        if (folder / name).exists() and not _due(manifest.get(name), now):
            status[name] = "fresh"
            continue
        try:
            raw = get(source, name)
            entry, found = manifest.get(name, {}), hashlib.sha256(raw).hexdigest()
            if entry.get("hash") == found and (folder / name).exists():
                manifest[name], status[name] = entry | {"checkedAt": now.isoformat()}, "same"
                save_manifest(folder, manifest)
                continue
            text, charset = normalised(raw)
            own = folder / (name + ".new")
            own.write_bytes(text)
            own.replace(folder / name)
            stamp = now.isoformat()
            manifest[name], status[name] = {"downloadedAt": stamp, "checkedAt": stamp, "hash": found, "source": f"{source}/{name}", "encoding": charset}, "written"
            save_manifest(folder, manifest)  # a crash later forgets no finished file
        except Exception:
            log.exception("%s keeps its local version", name)
            status[name] = "failed"
    return status


if __name__ == "__main__":
    sys.exit(int("failed" in refresh(*sys.argv[1:3]).values()))
