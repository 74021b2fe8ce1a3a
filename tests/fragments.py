"""Writes small label and data files for the tests."""

from __future__ import annotations

import numpy as np


def column(name: str, start: int, n_bytes: int, kind: str, extra: str = "") -> str:
    return f"  OBJECT = COLUMN\n    NAME = {name}\n    START_BYTE = {start}\n    BYTES = {n_bytes}\n    DATA_TYPE = {kind}\n{extra}  END_OBJECT = COLUMN\n"


def label(name: str, rows: np.ndarray, columns: list[str], keys: list[str] | None = None, pointer: str | None = None, extra: str = "") -> str:
    out = "PDS_VERSION_ID = PDS3 /* a comment */\n"
    out += f"RECORD_BYTES = {rows.dtype.itemsize}\n"
    if pointer:
        out += f"^TABLE = {pointer}\n"
    out += f"OBJECT = TABLE\n  NAME = {name}\n  ROWS = {len(rows)}\n  ROW_BYTES = {rows.dtype.itemsize}\n  COLUMNS = {len(columns)}\n"
    if keys:
        out += "  PRIMARY_KEY = (" + ", ".join(f'"{k}"' for k in keys) + ")\n"
    return out + extra + "".join(columns) + "END_OBJECT = TABLE\nEND\n"


def attached(path, name: str, rows: np.ndarray, columns: list[str], keys: list[str] | None = None, extra: str = "") -> None:
    """Label and data in one file; the data begin at a byte that the label names."""
    size = 4096
    text = label(name, rows, columns, keys, f"{size + 1} <BYTES>", extra).encode()
    assert len(text) <= size
    path.write_bytes(text + b"\n" * (size - len(text)) + rows.tobytes())


def var_block(values: list[int], order: str = ">") -> bytes:
    """A byte count and 16-bit whole numbers."""
    body = np.array(values, dtype=f"{order}i2").tobytes()
    return np.array([len(body)], dtype=f"{order}i2").tobytes() + body
