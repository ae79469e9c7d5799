"""Recursive text splitting: the coarsest separator that occurs cuts, pieces are merged up to the size, neighbours overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

SIZE, OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters (longer only where a separator-free part can't be cut, which "" rules out)."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    parts = [p for p in text.split(sep) if p] if sep else list(text)
    out: list[str] = []
    window: list[str] = []
    length = 0

    def flush() -> None:
        piece = sep.join(window).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size and finer:
            if window:
                flush()
                window, length = [], 0
            out += split_text(part, size, overlap, finer)
            continue
        extra = len(part) + (len(sep) if window else 0)
        if window and length + extra > size:
            flush()
            while window and (length > overlap or length + len(part) + len(sep) > size):
                length -= len(window[0]) + (len(sep) if len(window) > 1 else 0)
                window = window[1:]
        length += len(part) + (len(sep) if window else 0)
        window.append(part)
    flush()
    return out


def text_chunks(df: DataFrame, key: str, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_id, text): chunk numbers begin again with each text; null and blank texts have none."""

    def run(batches):
        for b in batches:
            keys, nums, chunks = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, c in enumerate(split_text(t, size, overlap) if t and t.strip() else []):
                    keys.append(k)
                    nums.append(i)
                    chunks.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(nums, pa.int32()), pa.array(chunks, pa.string())], [key, "chunk_id", "text"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, chunk_id int, text string")
