"""Token files compressed by a grammar: Re-Pair per shard, with expansion lengths so that a range decodes alone.

A file set is a Parquet folder with a row a shard:
part, shard: place in ascending doc_id order; at: ids before the shard in its part; n: ids that it expands to;
doc_ids, doc_n: its documents and their numbers of ids; base: the first nonterminal; width: bits a symbol;
n_rules, n_symbols: how many there are; rules: two symbols a nonterminal, from base on; symbols: the sequence;
spans: what each nonterminal expands to, in ids (32 bits, little-endian); blocks: the ids before every 1024th symbol
(64 bits). rules and symbols take `width` bits a value (`packed`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import part_offsets
from .shared import pieces, shared_dir, small_batches
from .tokens import encode_documents

SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_n", pa.list_(pa.int64())), ("base", pa.int64()), ("width", pa.int32()), ("n_rules", pa.int64()), ("n_symbols", pa.int64()), ("rules", pa.binary()), ("spans", pa.binary()), ("symbols", pa.binary()), ("blocks", pa.binary())])
SHARD_SQL = "part int, shard int, at long, n long, doc_ids array<bigint>, doc_n array<bigint>, base long, width int, n_rules long, n_symbols long, rules binary, spans binary, symbols binary, blocks binary"
BLOCK = 1024
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def packed(values: np.ndarray, width: int) -> bytes:
    """`width` bits a value: first the bytes of lowest order of all values, and so on, then the bits that are left, each in a plane of its own."""
    whole = [(values >> np.uint32(8 * k)).astype(np.uint8) for k in range(width // 8)]
    return b"".join(x.tobytes() for x in [*whole, *(np.packbits(values >> np.uint32(bit) & np.uint32(1), bitorder="little") for bit in range(width // 8 * 8, width))])


def unpacked(data: bytes, width: int, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values first .. last - 1 of n packed ones (first a multiple of 8); only their bytes are read."""
    last, out, at = n if last is None else last, np.zeros((n if last is None else last) - first, np.uint32), 0
    raw = np.frombuffer(data, np.uint8)
    for k in range(width // 8):
        out |= raw[at + first : at + last].astype(np.uint32) << np.uint32(8 * k)
        at += n
    for bit in range(width // 8 * 8, width):
        out |= np.unpackbits(raw[at + first // 8 : at + -(-last // 8)], count=last - first, bitorder="little").astype(np.uint32) << np.uint32(bit)
        at += -(-n // 8)
    return out


def frequent_pairs(codes: np.ndarray, half: int, least: int) -> np.ndarray:
    """Pairs that occur `least` times or more, sorted; the most frequent first claim their symbols, so that none ends one pair and begins another: only a pair of equal symbols can overlap itself."""
    spread = (codes * np.uint32(0x9E3779B1)) >> np.uint32(14) if half == 16 else ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).view(np.int64)
    codes = np.sort(codes[(np.bincount(spread, minlength=1 << 18) >= least)[spread]])
    if not len(codes):
        return codes
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    n = np.diff(np.concatenate([first, [len(codes)]]))
    pairs, n = codes[first[n >= least]], n[n >= least]
    begin: set[int] = set()
    end: set[int] = set()
    chosen = []
    for pair in pairs[np.argsort(-n, kind="stable")].tolist():
        a, b = pair >> half, pair & ((1 << half) - 1)
        if a not in end and b not in begin and (a != b or a not in begin and a not in end):
            begin.add(a)
            end.add(b)
            chosen.append(pair)
    return np.sort(np.array(chosen, codes.dtype))


def compress(ids: np.ndarray, base: int, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: gives (rules, spans, symbols). Each round replaces a set of frequent pairs by new nonterminals, equal symbols from the left, until no pair occurs `least` times, so that a rule saves that many symbols less the two it takes."""
    seq, known, rules = ids.astype(np.uint32), np.ones(base, np.uint32), [np.empty((0, 2), np.uint32)]
    while len(seq) > 1:
        half = 16 if len(known) <= 1 << 16 else 32
        kind = np.uint32 if half == 16 else np.uint64
        codes = seq[:-1].astype(kind)
        codes <<= kind(half)
        codes |= seq[1:]
        pairs = frequent_pairs(codes, half, max(2, least))
        if not len(pairs):
            break
        a, b = (pairs >> kind(half)).astype(np.int64), (pairs & kind((1 << half) - 1)).astype(np.int64)
        begins, ends = np.zeros((2, len(known)), bool)
        begins[a], ends[b] = True, True
        at = np.flatnonzero(begins[seq[:-1]] & ends[seq[1:]])
        where = np.minimum(np.searchsorted(pairs, codes[at]), len(pairs) - 1)
        hit = pairs[where] == codes[at]
        at, where = at[hit], where[hit]
        if (a == b).any():
            equal = (a == b)[where]
            run = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | ~equal[1:]]))
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate([run, [len(at)]])))
            at, where = at[~equal | (nth % 2 == 0)], where[~equal | (nth % 2 == 0)]
        seq[at] = len(known) + where
        left = np.ones(len(seq), bool)
        left[at + 1] = False
        seq = seq[left]
        known = np.concatenate([known, known[a] + known[b]])
        rules.append(np.stack([a, b], 1).astype(np.uint32))
    return np.concatenate(rules), known[base:], seq


def expand(symbols: np.ndarray, rules: np.ndarray, spans: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: a pass a level of the grammar over those symbols that are not yet ids."""
    size = np.concatenate([np.ones(base, np.int64), spans.astype(np.int64)])
    n = size[symbols]
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    while len(symbols):
        done = symbols < base
        out[first[done]] = symbols[done]
        pair, first = rules[symbols[~done].astype(np.int64) - base], first[~done]
        symbols, first = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([first, first + size[pair[:, 0]]])
    return out


def grammar(shard: dict) -> tuple[np.ndarray, np.ndarray]:
    """(rules, spans) of a shard."""
    return unpacked(shard["rules"], shard["width"], 2 * shard["n_rules"]).reshape(-1, 2), np.frombuffer(shard["spans"], "<u4")


def decode_range(shard: dict, start: int, n: int) -> np.ndarray:
    """Ids start .. start + n - 1 of one shard. Only the blocks of symbols that cover them are read."""
    if n < 1:
        return np.empty(0, np.uint32)
    rules, spans = grammar(shard)
    blocks = np.frombuffer(shard["blocks"], "<i8")
    a, b = np.searchsorted(blocks, start, "right") - 1, np.searchsorted(blocks, start + n - 1, "right")
    symbols = unpacked(shard["symbols"], shard["width"], shard["n_symbols"], int(a) * BLOCK, min(int(b) * BLOCK, shard["n_symbols"]))
    ends = blocks[a] + np.cumsum(np.concatenate([np.ones(shard["base"], np.int64), spans.astype(np.int64)])[symbols])
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n - 1, "right")
    skip = start - int(ends[first - 1] if first else blocks[a])
    return expand(symbols[first : last + 1], rules, spans, shard["base"])[skip : skip + n]


def write_files(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = 2, shard_ids: int = 400_000) -> None:
    """Writes the ids of all documents under path, in ascending doc_id order (nulls first, equal ids by text)."""

    def shard(part: int, k: int, at: int, docs: list, ns: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        stream = np.concatenate(ids)
        rules, spans, symbols = compress(stream, vocabulary)
        width = int(vocabulary + len(rules) - 1).bit_length()
        sizes = np.concatenate([np.ones(vocabulary, np.int64), spans.astype(np.int64)])[symbols]
        blocks = (np.cumsum(sizes) - sizes)[::BLOCK]
        row = {"part": part, "shard": k, "at": at, "n": len(stream), "doc_ids": docs, "doc_n": np.concatenate(ns).tolist(), "base": vocabulary, "width": width, "n_rules": len(rules), "n_symbols": len(symbols), "rules": packed(rules.reshape(-1), width), "spans": spans.astype("<u4").tobytes(), "symbols": packed(symbols, width), "blocks": blocks.astype("<i8").tobytes()}
        return pa.RecordBatch.from_pylist([row], SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, at, held = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        ns: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for first, texts in pieces(batch.column("text"), 8 << 20):
                got, n = encode_documents(tokenizer, texts, end_id)
                names, ends, done = batch.column("doc_id").slice(first, len(n)).to_pylist(), np.cumsum(n), 0
                while done < len(n):
                    before = int(ends[done - 1]) if done else 0
                    last = min(len(n), int(np.searchsorted(ends, before + shard_ids - held)) + 1)
                    docs += names[done:last]
                    ns.append(n[done:last])
                    ids.append(got[before : ends[last - 1]])
                    held += int(ends[last - 1]) - before
                    done = last
                    if held >= shard_ids:
                        yield shard(part, k, at, docs, ns, ids)
                        k, at, held, docs, ns, ids = k + 1, at + held, 0, [], [], []
        if docs:
            yield shard(part, k, at, docs, ns, ids)

    small_batches(docs.sparkSession)
    tie = F.xxhash64("text")
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    placed.mapInArrow(run, SHARD_SQL).write.option("compression", "zstd").parquet(path)


def read_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """A row a document, decoded: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and with_ids its ids."""
    shards = spark.read.schema(SHARD_SQL).parquet(path)
    before = part_offsets(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                data = expand(unpacked(row["symbols"], row["width"], row["n_symbols"]), *grammar(row), row["base"]).astype("<u4").tobytes()
                n = np.array(row["doc_n"], np.int64)
                ends = np.cumsum(n)
                if len(data) != 4 * row["n"]:
                    raise ValueError(f"shard {row['part']}/{row['shard']} expands to {len(data) // 4} ids, not {row['n']}")
                own = [data[4 * b - 4 * k : 4 * b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(before[row["part"]] + row["at"] + ends - n), pa.array(n), pa.array(list(map(zlib.crc32, own)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, [x.split()[0] for x in ROWS.split(", ")] + ["ids"] * with_ids)

    return shards.mapInArrow(run, ROWS + ", ids binary" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, vocabulary: int, path: str | None = None, **options) -> DataFrame:
    """Writes the files (under the shared folder unless a path is given) and reads them back.

    Null and empty texts are one end_id. Every row has its own place, repeated rows too; a null doc_id comes
    first and stays null; other columns are ignored; an empty table gives no rows. Texts of any length are cut by
    document only: a shard ends with the first document that fills it.
    """
    import uuid

    path = path or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer, vocabulary, **options)
    return read_files(docs.sparkSession, path)


__all__ = ["compress", "decode_range", "expand", "read_files", "token_files", "write_files"]
