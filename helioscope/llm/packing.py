"""Packing by concatenating and cutting: two passes of prefix sums give each document its place in one long stream, which fixed windows cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, pieces, small_batches
from .tokens import encode_documents

TOKENS = "part int, at long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows (part, at, doc_id, n, ids): each text's ids with end_id, little-endian; `at` counts the ids before it in its part. Written once, so both passes see one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in pieces(batch.column("text")):
                ids, n = encode_documents(tokenizer, texts, end_id)
                ends = np.cumsum(n)
                data, cuts = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], ends])).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), batch.column("doc_id").slice(first, len(n)).cast(pa.int64()), pa.array(n), pa.array([data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                    ["part", "at", "doc_id", "n", "ids"],
                )
                at += int(ends[-1]) if len(ends) else 0

    small_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", "text").mapInArrow(run, TOKENS), "tokens")


def part_offsets(table: DataFrame, n: str = "n") -> dict[int, int]:
    """The ids before each part: as many rows as parts reach the driver."""
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum(n).alias("n")).collect())
    return dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0), strict=False))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, with_ids: bool = False) -> DataFrame:
    """Packs documents into sequences of `window` ids; only the last one can be shorter.

    A row is a piece: part of one document in one sequence. A document that spans a window's end has a
    boundary piece on either side. Null and empty texts are one end_id. Rows with equal ids are packed each by
    itself; a null doc_id stays null; other columns are ignored. An empty table gives no rows.
    with_ids adds the piece's ids (binary, little-endian 32 bits).
    """
    table = tokenize(docs, tokenizer, end_id)
    before = part_offsets(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for part, at, doc, n, ids in zip(*(batch.column(k).to_pylist() for k in ("part", "at", "doc_id", "n", "ids")), strict=True):
                place, start = before[part] + at, 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    length = min(n - start, window - offset)
                    data = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, start, length, zlib.crc32(data), n, sequence, offset, data), strict=True):
                        column.append(value)
                    start += length
            columns = [pa.array(x, pa.int64()) for x in out[:7]] + [pa.array(out[7], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    return table.mapInArrow(run, PIECES + ", ids binary" * with_ids)
