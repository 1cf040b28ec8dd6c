"""Sinks for small results: an atomic pair of files, CSV, JSON and Markdown. Large tables go through DataFrame.write."""

from __future__ import annotations

import csv
import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def publish(rows: list[dict], manifest: list[dict], output: str, manifest_path: str, contract: str) -> str:
    """Write rows as JSON lines and a manifest that names their digest, both or neither; returns the digest.

    Refused: no rows, one path for both, and paths that are links or no plain files. What was
    there before comes back if the second file can't be put in place.
    """
    out, man = Path(output), Path(manifest_path)
    if not rows:
        raise ValueError("nothing to publish")
    if out.resolve() == man.resolve():
        raise ValueError("output and manifest are one file")
    for p in (out, man):
        if p.is_symlink() or p.exists() and not p.is_file():
            raise ValueError(f"{p} is no plain file")
        if not p.parent.is_dir():
            raise ValueError(f"{p.parent} is no folder")
    data = "".join(canonical(r) + "\n" for r in rows).encode()
    digest = hashlib.sha256(data).hexdigest()
    listed = json.dumps({"version": 1, "contract": contract, "output_sha256": digest, "rows": manifest}, sort_keys=True, indent=2).encode() + b"\n"
    made = []
    before = {p: p.read_bytes() if p.exists() else None for p in (out, man)}
    try:
        for p, content in ((out, data), (man, listed)):
            temp = p.with_name(f".{p.name}.{os.getpid()}.new")
            made.append(temp)
            with temp.open("wb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
        os.replace(made[0], out)
        try:
            os.replace(made[1], man)
        except OSError:
            out.unlink(missing_ok=True) if before[out] is None else out.write_bytes(before[out])
            raise
    finally:
        for temp in made:
            temp.unlink(missing_ok=True)
    return digest


def rows_of(df: DataFrame, most: int = 1_000_000) -> list[dict]:
    """A result that is small by nature, in the order of its columns; more than `most` rows are refused."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write the table instead")
    return sorted(rows, key=lambda r: json.dumps(r, default=str))


def write_csv(df: DataFrame, path: str) -> None:
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, df.columns)
        writer.writeheader()
        writer.writerows(rows_of(df))


def write_json(df: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps(rows_of(df), indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def markdown(df: DataFrame, digits: int = 3) -> str:
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[c]) for c in df.columns) + " |" for r in rows_of(df))]) + "\n"


def mean_std(mean: float, std: float) -> str:
    return f"{mean:.3f} ± {std:.3f}"
