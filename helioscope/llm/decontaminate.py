"""Benchmark decontamination by the CGK embedding: a random walk that maps edit distance to Hamming distance, and bit sampling over it.

Text and items are read as words (letters and digits, lower-cased), so spacing and punctuation don't matter. An
item of n words is found where a stretch of words has an edit distance of at most rate * n to it.
1. By the q-gram lemma such a stretch holds n - 1 - 2 * distance of the item's word pairs; only windows with as many
   pairs of some item of their size go on. Nothing that matches is lost there.
2. Items and windows of item size are embedded by the same random walks: at each step the current word is copied, and a
   random bit of step and word says whether to advance. Sampled coordinates, several tables of them, are hashed; a window and an
   item that agree in any table are a candidate. The number of tables is raised until simulated items with
   all edits they may have are recalled at the target rate. Sizes that don't reach it with MOST_TABLES (long items) aren't
   hashed: for each of their items, what holds enough of its pairs goes straight to the edit distance.
3. A candidate's exact edit distance, over every end of the stretch, decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, pieces, ragged, small_batches

NOT_WORD = r"[^\p{L}\p{N}\p{M}]+"
MATCHES = "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long"
WALKS = 4
MOST_TABLES = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, one text after another, and where each text's words end. The same for items and documents."""
    clean = pc.utf8_lower(pc.fill_null(texts, ""))
    parts = pc.ascii_split_whitespace(pc.utf8_trim(pc.replace_substring_regex(clean, NOT_WORD, " "), " "))
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    word = (pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0) if len(flat) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(word)])[np.cumsum(sizes)]
    return flat.filter(pa.array(word)), ends


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """(least edit distance of item to a prefix of text, that prefix's length), the shortest on ties; most + 1 if above most."""
    row = np.arange(len(text) + 1)
    for i, w in enumerate(item.tolist(), 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        new = np.concatenate([[i], new])
        steps = np.arange(len(new))
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return (int(row[end]), end) if row[end] <= most else (most + 1, 0)


def start_distances(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each start in text, the least edit distance of item to a stretch from there on: one pass from the back, in which a stretch may end anywhere."""
    back, steps = text[::-1], np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item[::-1].tolist(), 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (back != w))])
        row = np.minimum.accumulate(new - steps) + steps
    return row[:0:-1]


class Items:
    """One block of items, ready for search."""

    def __init__(self, ids: list[int], texts: list[str], rate: float, recall: float, seed: int = 11) -> None:
        flat, ends = words_of(pa.array(texts, pa.string()))
        self.vocabulary = pc.unique(flat)
        code = pc.index_in(flat, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # 0: a word of no item
        own = [(i, w) for i, w in zip(ids, np.split(code, ends[:-1]) if ids else [], strict=True) if len(w)]
        self.ids, self.items = [i for i, _ in own], [w for _, w in own]
        self.size = len(self.vocabulary) + 2
        self.pad = self.size - 1
        self.most = [int(rate * len(w)) for w in self.items]
        self.pairs = np.unique(np.concatenate([w[:-1] * self.size + w[1:] for w in self.items] or [np.empty(0, np.int64)]))
        self.marks = np.zeros(1 << 22, bool)  # a quick test before the search among the pairs
        self.marks[self._mark(self.pairs)] = True
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(self.items):
            by_size[len(w)].append(k)
        self.by_size = dict(by_size)
        self.of_size = {n: np.isin(self.pairs, np.concatenate([self.items[k][:-1] * self.size + self.items[k][1:] for k in members])) for n, members in by_size.items()}
        self.salts = np.random.default_rng(seed).integers(1, 1 << 63, (WALKS, 2 * max(map(len, self.items), default=1)), np.uint64)
        self.samples: dict[int, np.ndarray] = {}
        #: For each hashed size and table the sorted keys of its items, and whose they are. None for a size whose recall is too low.
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, members in self.by_size.items():
            self._fit(n, members, recall)

    def keys(self, windows: np.ndarray, samples: np.ndarray) -> np.ndarray:
        """[table, window] hashes of what the walks copy at the sampled steps. windows: rows of word codes, padded. A walk's bit comes from a hash of its step's salt and the word, so nothing is kept but one place a window."""
        out = np.zeros((len(samples), len(windows)), np.uint64)
        rows, wide = np.arange(len(windows)), windows.shape[1]
        for r in range(WALKS):
            mine = samples[r::WALKS]
            at = np.zeros(len(windows), np.int64)
            for step in range(int(mine.max()) + 1 if mine.size else 0):
                w = np.where(at < wide, windows[rows, np.minimum(at, wide - 1)], self.pad).astype(np.uint64)
                for t in np.flatnonzero((mine == step).any(1)).tolist():
                    key = out[t * WALKS + r]
                    key ^= w + np.uint64(1)
                    key *= MIX
                    key ^= key >> np.uint64(29)
                z = ((w + np.uint64(1)) * MIX ^ self.salts[r, step]) * MIX
                at += ((z ^ z >> np.uint64(31)) * MIX >> np.uint64(63)).astype(np.int64)
        return out

    def chunk(self, n: int, d: int, tables: int) -> int:
        """How many windows are embedded at once: so that windows and keys take some 64 MB, whatever the size of the item."""
        return max(1, (8 << 20) // (n + d + tables))

    def _fit(self, n: int, members: list[int], recall: float) -> None:
        d, rng = self.most[members[0]], np.random.default_rng(n)
        edited = np.full((200, n + d), self.pad, np.int64)
        truth = rng.integers(0, len(members), 200)
        for row, k in zip(edited, truth, strict=True):
            w = self.items[members[k]].tolist()
            for _ in range(d):
                at = int(rng.integers(0, len(w) + 1))
                how = int(rng.integers(0, 3))
                if how == 0 and len(w) > 1:
                    del w[min(at, len(w) - 1)]
                elif how == 1:
                    w.insert(at, 0)
                else:
                    w[min(at, len(w) - 1)] = 0
            row[: min(len(w), len(row))] = w[: len(row)]
        whole = np.stack([self.items[members[k]] for k in truth])
        tables = 8
        while True:
            samples = np.stack([np.sort(np.random.default_rng(n * 1000 + t).choice(2 * n, min(3, 2 * n), replace=False)) for t in range(tables)])
            if (self.keys(whole, samples) == self.keys(edited, samples)).any(0).mean() >= recall:
                break
            if tables >= MOST_TABLES:
                return
            tables *= 2
        step = self.chunk(n, 0, tables)
        found = np.concatenate([self.keys(np.stack([self.items[k] for k in members[i : i + step]]), samples) for i in range(0, len(members), step)], 1)
        order = np.argsort(found, 1, kind="stable")
        self.samples[n] = samples
        self.tables[n] = [(row[o], np.array(members, np.int64)[o]) for row, o in zip(found, order, strict=True)]

    def candidates(self, n: int, windows: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) that agree in a table."""
        met = [np.empty(0, np.int64)]
        for (keys, owner), own in zip(self.tables[n], self.keys(windows, self.samples[n]), strict=True):
            low = np.searchsorted(keys, own, "left")
            size = np.searchsorted(keys, own, "right") - low
            if len(hit := np.flatnonzero(size)):
                met.append(np.repeat(hit, size[hit]) * len(self.items) + owner[ragged(low[hit], size[hit])])
        found = np.unique(np.concatenate(met))
        return list(zip((found // len(self.items)).tolist(), (found % len(self.items)).tolist(), strict=True))

    @staticmethod
    def _mark(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def starts(self, n: int, d: int, words: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Where windows of n + d words hold n - 1 - 2 * d of the pairs at `mine`; all known words if that is none."""
        need = n - 1 - 2 * d
        if need <= 0:
            return np.flatnonzero(words > 0)
        if len(mine) < need:
            return mine[:0]
        first, last = mine[: len(mine) - need + 1], mine[need - 1 :]
        near = last + 1 - first < n + d  # the pairs first .. last fit into one window
        starts = [np.arange(b + 2 - n - d, a + 1) for a, b in zip(first[near].tolist(), last[near].tolist(), strict=True)]
        return np.unique(np.maximum(np.concatenate(starts), 0)) if starts else mine[:0]

    def _search_exactly(self, k: int, d: int, words: np.ndarray, ends: np.ndarray, start: np.ndarray, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Puts item k's best stretch in each text into best. Near starts of one text are compared at once."""
        reach, text = len(self.items[k]) + d, np.searchsorted(ends, start, "right")
        cut = np.flatnonzero((np.diff(start) > reach) | (np.diff(text) > 0)) + 1
        for first, last in zip([0, *cut.tolist()], [*cut.tolist(), len(start)], strict=True):
            if first == last:
                continue
            own, s = int(text[first]), int(start[first])
            distances = start_distances(self.items[k], words[s : min(int(start[last - 1]) + reach, int(ends[own]))])
            s += int(distances.argmin())
            distance = int(distances.min())
            if distance <= d and ((own, k) not in best or (distance, s) < best[own, k][:2]):
                best[own, k] = (distance, s, s + edit_distance(self.items[k], words[s : min(s + reach, int(ends[own]))], d)[1])

    def search(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of the best stretch of each item in each text: least distance, then first. words: all texts' words, one after another, ends: where each ends."""
        if not len(self.items) or not len(words):
            return []
        known = words > 0
        at = np.flatnonzero(known[:-1] & known[1:])
        code = words[at] * self.size + words[at + 1]
        some = self.marks[self._mark(code)]
        at, code = at[some], code[some]
        pair = np.searchsorted(self.pairs, code)
        real = self.pairs[np.minimum(pair, len(self.pairs) - 1)] == code if len(self.pairs) else np.zeros(len(code), bool)
        at, pair = at[real], pair[real]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        by_pair = np.argsort(pair, kind="stable")
        bounds = np.searchsorted(pair[by_pair], np.arange(len(self.pairs) + 1))
        for n, members in self.by_size.items():
            d = self.most[members[0]]
            if n not in self.tables:
                for k in members:
                    own = np.searchsorted(self.pairs, np.unique(self.items[k][:-1] * self.size + self.items[k][1:]))
                    mine = np.sort(at[by_pair[ragged(bounds[own], bounds[own + 1] - bounds[own])]])
                    self._search_exactly(k, d, words, ends, self.starts(n, d, words, mine), best)
                continue
            start = self.starts(n, d, words, at[self.of_size[n][pair]])
            step = self.chunk(n, d, len(self.samples[n]))
            for a in range(0, len(start), step):
                part = start[a : a + step]
                text = np.searchsorted(ends, part, "right")
                place = part[:, None] + np.arange(n + d)[None, :]
                windows = np.where(place < ends[text][:, None], words[np.minimum(place, len(words) - 1)], self.pad)
                for i, k in self.candidates(n, windows):
                    s, own = int(part[i]), int(text[i])
                    if (own, k) in best and best[own, k][:2] <= (0, s):
                        continue  # nothing beats an exact stretch that comes before
                    distance, length = edit_distance(self.items[k], words[s : min(s + n + d, int(ends[own]))], d)
                    if distance <= d and ((own, k) not in best or (distance, s) < best[own, k][:2]):
                        best[own, k] = (distance, s, s + length)
        base = np.concatenate([[0], ends])
        return [(own, k, v[0], v[1] - int(base[own]), v[2] - int(base[own])) for (own, k), v in sorted(best.items())]


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.1, recall: float = 0.99, block_words: int = 2_000_000) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, distance, item_words, start_word, end_word (exclusive).

    The best stretch is told: the least distance, then the first. Items of up to `block_words` words in all (some
    30,000 items of usual size; a longer item is a block by itself) are one broadcast index and one scan of the
    documents; a larger benchmark takes as many scans as it has such blocks, so what a task holds doesn't grow
    with it. Null texts and texts without a word, of either table, match nothing; texts of any length are searched
    whole. Repeated rows, of either table, are searched and returned each; null ids stay null; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = []

    def search(rows: list) -> DataFrame:
        made = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], rate, recall))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Items = made.value
            for batch in batches:
                out: list[tuple] = []
                for first, texts in pieces(batch.column("text"), 4 << 20):
                    flat, ends = words_of(texts)
                    code = pc.fill_null(pc.index_in(flat, index.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                    ids = batch.column("doc_id").slice(first, len(texts)).to_pylist()
                    out += [(ids[i], index.ids[k], distance, len(index.items[k]), a, b) for i, k, distance, a, b in index.search(code, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 6)], [x.split()[0] for x in MATCHES.split(", ")])

        return docs.select("doc_id", "text").mapInArrow(run, MATCHES)

    held: list = []
    size = 0
    for row in items.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"].split())
        if held and size + n > block_words:
            found.append(search(held))
            held, size = [], 0
        held.append(row)
        size += n
    if held or not found:
        found.append(search(held))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs' rows in whose text no item was found, with all columns. Rows are told apart by doc_id and text, so rows of one doc_id don't share a verdict, and repeated rows do."""
    (name,) = fresh(docs, "_key")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    leaks = find_leaks(docs.select(key.alias("doc_id"), "text"), items, **options)
    return docs.withColumn(name, key).join(leaks.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").drop(name)


__all__ = ["Items", "edit_distance", "find_leaks", "without_leaks"]
