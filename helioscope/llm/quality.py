"""Quality rules with controlled risk: labelled holdouts and exact binomial bounds choose each stratum's cutoffs."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import column, materialize, pieces, small_batches, trim

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A document is worse the higher any of these is.
RATIOS = ["symbols", "dup_lines", "repeats", "capitals", "long_words", "short_words", "marked_words"]
SPACE = " \t\n\x0b\x0c\r"
EDGE = re.compile(r"^\W+|\W+$")


def measures(texts: pa.Array, marked: dict[str, frozenset[str]] | None = None, langs: pa.Array | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts, and a row of RATIOS, of each text (null: empty). marked: the marked words of each language, "" those for any other; langs: the texts' languages."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(texts)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    chars = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    ids, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    word, owner = chars > 0, np.repeat(np.arange(len(sizes)), sizes)  # leading and trailing space gives empty parts
    total = lambda x: np.bincount(owner[word], x[word], len(sizes)).astype(np.int64)
    out = {"n_words": total(np.ones(len(ids))), "word_chars": total(chars), "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64), "n_dup_lines": np.zeros(len(sizes), np.int64), "n_repeat_words": np.zeros(len(sizes), np.int64)}
    bad = np.zeros(len(ids), bool)
    if marked and len(ids):
        names, own = np.unique([x if x in marked else "" for x in langs.to_pylist()], return_inverse=True)
        stems = [EDGE.sub("", w).lower() for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        bad = np.array([[w in marked.get(x, ()) for w in stems] for x in names])[own[owner], ids]
    lines = np.zeros(len(sizes), np.int64)
    own, ends = ids[word], np.cumsum(out["n_words"])
    for i, text in enumerate(texts.to_numpy(zero_copy_only=False)):
        if "\n" in text:
            with_word = [x for x in text.split("\n") if x.strip(SPACE)]
            lines[i], out["n_dup_lines"][i] = len(with_word), len(with_word) - len(set(with_word))
        w = own[ends[i] - out["n_words"][i] : ends[i]]
        if len(w) > 3:
            three = (w[:-2] * vocabulary + w[1:-1]) * vocabulary + w[2:] if vocabulary < 2_000_000 else np.unique(np.stack([w[:-2], w[1:-1], w[2:]], 1), axis=0, return_inverse=True)[1].ravel()
            order = np.sort(three)
            if len(again := np.unique(order[1:][order[1:] == order[:-1]])):
                hit, cover = np.isin(three, again), np.zeros(len(w), bool)
                cover[:-2] |= hit
                cover[1:-1] |= hit
                cover[2:] |= hit
                out["n_repeat_words"][i] = cover.sum()
    n, c = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    capitals = pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False)
    ratios = [out["n_symbols"] / c, out["n_dup_lines"] / np.maximum(lines, 1), out["n_repeat_words"] / n, capitals / c, c / n, -c / n, total(bad) / n]
    return out, np.stack(ratios, 1).astype(np.float64)


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def at_most(k: int, n: int, p: float) -> float:
    """The probability of k or fewer of n at the rate p (between 0 and 1)."""
    i = np.arange(1, k + 1)
    logs = n * math.log1p(-p) + np.cumsum(np.concatenate([[0.0], np.log((n - i + 1) / i) + math.log(p) - math.log1p(-p)]))
    return float(np.exp(logs).sum())


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper and Pearson's upper bound of a rate at k of n: the p at which k or fewer have probability `error`."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and at_most(k, n, mid) > error else (low, mid)
    return high


def coarse(x: np.ndarray) -> np.ndarray:
    """Values rounded down to nine binary digits, so there are few different ones however many rows."""
    m, e = np.frexp(x)
    return np.ldexp(np.floor(m * 512) / 512, e) + 0.0


def tally(held: DataFrame | tuple[np.ndarray, ...], cells: Callable[..., Iterable[tuple[str, int, np.ndarray, np.ndarray | None]]]) -> Counter:
    """(name, ratio, key) -> the sum over all rows of `held`, of which `cells` gives (name, ratio, keys, numbers to add; None: 1 each).

    `held` has (lang, ordering, clean, ratios), as columns of a DataFrame or as arrays. A DataFrame's rows are summed on
    the executors: the driver gets a number a cell, and no rows.
    """

    def summed(*rows: np.ndarray) -> Counter:
        out: Counter = Counter()
        for name, j, keys, numbers in cells(*rows):
            found, at = np.unique(keys, return_inverse=True)
            for k, n in zip(found.tolist(), np.bincount(at, numbers, len(found)).tolist(), strict=True):
                out[name, j, k] += int(n)
        return out

    if not isinstance(held, DataFrame):
        return summed(*held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            flags = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("ordering", "clean"))
            total.update(summed(np.array(batch.column("lang").to_pylist(), object), *flags, batch.column("ratios").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RATIOS))))
        for some in batched(total.items(), 10_000):
            columns = zip(*((*cell, n) for cell, n in some), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["name", "ratio", "key", "n"])

    sums = held.mapInArrow(run, "name string, ratio int, key long, n long").groupBy("name", "ratio", "key").agg(F.sum("n").alias("n"))
    return Counter({(r["name"], r["ratio"], r["key"]): r["n"] for r in sums.collect()})


def candidates(counts: Counter, name: str, most: int = 64) -> list[np.ndarray]:
    """Each ratio's candidate cutoffs, highest first: evenly spaced quantiles of the stratum's bad ordering rows. Keys of counts are the bits of coarse values."""
    out = []
    for j in range(len(RATIOS)):
        bits, n = np.array([(k, n) for (s, i, k), n in counts.items() if (s, i) == (name, j)], np.int64).reshape(-1, 2).T
        values = np.ascontiguousarray(bits).view(np.float64)
        order = np.argsort(values)
        ends = np.cumsum(n[order])
        ranks = (np.linspace(0, 1, most) * (ends[-1] - 1)).astype(np.int64) if len(ends) else np.empty(0, np.int64)
        out.append(np.unique(values[order][np.searchsorted(ends, ranks, side="right")])[::-1])
    return out


def paths(grids: dict[str, list[np.ndarray]], worths: Callable[[dict[str, list[float]]], Counter]) -> dict[str, list[tuple[int, float]]]:
    """Each stratum's steps (ratio, cutoff) from the most lenient rule to stricter ones, found on rows that no test will use: again and again one ratio's cutoff is lowered, notch by notch, to where most further bad rows less ten times the clean ones fall, until nothing helps.

    worths: from the cutoffs so far, (stratum, ratio, notch) -> the bad rows less ten times the clean ones that pass all
    cutoffs and whose ratio first reaches the grid there. All strata that go on take their next step at once.
    """
    steps: dict[str, list[tuple[int, float]]] = {name: [] for name in grids}
    notch, cutoffs = {name: [0] * len(RATIOS) for name in grids}, {name: [math.inf] * len(RATIOS) for name in grids}
    while cutoffs:
        found = worths(cutoffs)
        for name in list(cutoffs):
            gains = [np.cumsum([found[name, j, k] for k in range(len(grid))]) if len(grid) else np.zeros(1) for j, grid in enumerate(grids[name])]
            j = int(np.argmax([g.max() for g in gains]))
            if gains[j].max() <= 0:
                del cutoffs[name]
                continue
            k = int(gains[j].argmax())
            steps[name] += [(j, float(c)) for c in grids[name][j][notch[name][j] : k + 1]]
            notch[name][j], cutoffs[name][j] = k + 1, float(grids[name][j][k])
    return steps


def first_over(steps: list[tuple[int, float]], ratios: np.ndarray) -> np.ndarray:
    """The step from which each row is rejected; len(steps) if none rejects it."""
    out = np.full(len(ratios), len(steps))
    for i, (j, c) in reversed(list(enumerate(steps))):
        out[ratios[:, j] >= c] = i
    return out


def allowed(steps: list[tuple[int, float]], counts: list[int], risk: float, error: float) -> list[float]:
    """The cutoffs after the longest run of steps of which each passes its test: that the rule as a whole, all ratios together, rejects at most `risk` of the stratum's clean documents.

    counts: the clean holdout rows by `first_over`. The steps were fixed before, and testing stops at the first that
    fails, so all tests of the stratum together err with probability `error` at most.
    """
    cutoffs, k, n = [math.inf] * len(RATIOS), 0, sum(counts)
    for (j, c), more in zip(steps, counts, strict=False):
        k += more
        if not n or k / n > risk or at_most(k, n, risk) > error:
            break
        cutoffs[j] = min(cutoffs[j], c)
    return cutoffs


def controlled(steps: list[tuple[int, float]], clean: np.ndarray, risk: float, error: float) -> list[float]:
    """`allowed` from the ratios of clean holdout rows."""
    return allowed(steps, np.bincount(first_over(steps, clean), minlength=len(steps) + 1).tolist(), risk, error)


def quota(counts: list[int], sample: int) -> int:
    """The largest q with which q rows of each stratum, or all if it has fewer, are at most `sample` rows (at least 1). Nothing here draws rows by it: `fit` takes all."""
    left = sample
    for i, n in enumerate(ordered := sorted(counts)):
        if n * (len(ordered) - i) > left:
            return max(1, left // (len(ordered) - i))
        left -= n
    return max([1, *counts])


def marked_words(rows: DataFrame, most: int = 500) -> dict[str, frozenset[str]]:
    """The marked words of each language, from (lang, text, toxic boolean): those at least 20 times as frequent, by document, in its toxic texts as in its others, and in one in twenty of its toxic texts (three at least).

    "" has the words of all languages that are as much more frequent over all texts; it stands for every language in which none is found.
    Words are counted on the executors. The driver gets a language's words that one in twenty of its toxic texts
    hold: at most twenty times as many as such a text has distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem = lru_cache(1 << 16)(lambda w: EDGE.sub("", w).lower())
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = [*zip(*((*k, n) for k, n in seen.items()), strict=True)] or [()] * 4
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["lang", "word", "toxic", "n"])

        for batch in batches:
            for lang, text, toxic in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen.update((lang, w, int(toxic)) for w in set(map(stem, (text or "").split())) - {""})
                if len(seen) > 100_000:
                    yield out()
        yield out()

    n = {r["lang"]: (r["n"] - r["toxic"], r["toxic"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).collect()}
    seen = rows.mapInArrow(run, "lang string, word string, toxic long, n long").groupBy("lang", "word").agg(F.sum(F.col("toxic") * F.col("n")).alias("bad"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("other"))
    seen = materialize(seen, "words")
    least = rows.sparkSession.createDataFrame([(k, max(1, a), max(1, b)) for k, (a, b) in n.items()], "lang string, n_other long, n_bad long")  # a row a language
    own = seen.join(F.broadcast(least), "lang").filter("bad >= greatest(3, n_bad / 20) and bad / n_bad >= 20 * other / n_other")
    found: dict[str, list[str]] = defaultdict(list)
    for r in sorted(own.select("lang", "word", "bad").collect(), key=lambda r: (-r["bad"], r["word"])):
        if len(found[r["lang"]]) < most:
            found[r["lang"]].append(r["word"])
    words = rows.sparkSession.createDataFrame([(w,) for w in sorted({w for x in found.values() for w in x})], "word string")
    clean, bad = (max(1, sum(x[t] for x in n.values())) for t in (0, 1))
    pooled = seen.join(F.broadcast(words), "word").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("other").alias("other")).filter(F.col("bad") / bad >= 20 * F.col("other") / clean)
    found[""] = [r["word"] for r in pooled.collect()]
    return {k: frozenset(v) for k, v in found.items()}


def fit(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> tuple[dict[str, frozenset[str]], dict[str, list[float]]]:
    """(marked words, cutoffs of each language), fitted on every labelled row.

    By the hash of doc_id, a third of these finds the marked words, a sixth the order of steps (`paths`), and a half is
    the holdout of the tests. Strata are the languages whose clean holdout rows (quality 1, not toxic) could pass a test, and one more, "",
    for all other languages together; if that one is too small as well, it takes in all rows. With probability
    1 - error, the rule of no stratum rejects more than `risk` of that stratum's clean documents: each of the S
    strata is tested at error / S, and its rule as a whole. A stratum for which even that fails has no cutoff but
    the base rule's. Rows with a null doc_id or label are left out; of repeated doc_ids in labels the worst
    label counts.

    Of the texts only the third with the words is shuffled; the others are measured where they lie, and their ratios meet the labels.
    """
    own = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_x")).hint("merge")  # the labels grow with the documents: one plan at every size
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    dealt = F.pmod(F.xxhash64("_id"), F.lit(6))
    docs = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", lang.alias("lang")).filter("_id is not null").withColumn("part", dealt)
    marked = marked_words(docs.filter("part < 2").join(own, "_id").select("lang", "text", (F.col("_x") > 0).alias("toxic")))
    trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column("text")):
                part = batch.slice(first, len(texts))
                m, ratios = measures(texts, marked, part.column("lang"))
                whole = pa.RecordBatch.from_arrays([part.column("_id"), part.column("lang"), pa.array(part.column("part").to_numpy() == 2), pa.array(ratios.tolist(), pa.list_(pa.float64()))], ["_id", "lang", "ordering", "ratios"])
                yield whole.filter(pa.array(~base_failed(m)))

    measured = docs.filter("part > 1").select("_id", "text", "lang", "part").mapInArrow(run, "_id long, lang string, ordering boolean, ratios array<double>")
    clean = ((F.col("_q") == 1) & (F.col("_x") == 0)).alias("clean")
    return marked, chosen(materialize(measured.join(own, "_id").select("lang", "ordering", clean, "ratios"), "held"), risk, error)


def chosen(held: DataFrame | list[tuple[str, bool, bool, list[float]]], risk: float, error: float) -> dict[str, list[float]]:
    """The cutoffs of each language from (lang, ordering: for the order of steps rather than the tests, clean, ratios); "": those of every language not named. Of a DataFrame, the driver gets counts by language, ratio and cutoff."""
    if not isinstance(held, DataFrame):
        held = (np.array([r[0] for r in held], object), *(np.array([r[k] for r in held], bool) for k in (1, 2)), np.array([r[3] for r in held], np.float64).reshape(-1, len(RATIOS)))
    sizes = tally(held, lambda langs, ordering, clean, _: ((x, 0, (clean & ~ordering)[langs == x].astype(np.int64), None) for x in set(langs)))
    names = sorted({x for x, _, _ in sizes} - {""})
    each = error / (len(names) + 1)
    able = lambda n: upper_bound(0, n, each) <= risk
    strata = [x for x in names if able(sizes[x, 0, 1])]
    whole = not able(sum(n for (x, _, test), n in sizes.items() if test and x not in strata))

    def groups(langs: np.ndarray) -> list[tuple[str, np.ndarray]]:
        rest = np.array([whole or x not in strata for x in langs], bool)
        return [(x, rows) for x, rows in [*((x, langs == x) for x in strata), ("", rest)] if rows.any()]

    def bad(langs: np.ndarray, ordering: np.ndarray, clean: np.ndarray, ratios: np.ndarray) -> Iterator[tuple]:
        for x, rows in groups(langs):
            for j in range(len(RATIOS)):
                yield x, j, coarse(ratios[rows & ordering & ~clean, j]).view(np.int64), None

    values = tally(held, bad)
    grids = {x: candidates(values, x) for x in [*strata, ""]}

    def worths(cutoffs: dict[str, list[float]]) -> Counter:
        def cells(langs: np.ndarray, ordering: np.ndarray, clean: np.ndarray, ratios: np.ndarray) -> Iterator[tuple]:
            for x, rows in groups(langs):
                if x in cutoffs:
                    left = rows & ordering & (ratios < cutoffs[x]).all(1)
                    for j, grid in enumerate(grids[x]):
                        notch = len(grid) - np.searchsorted(grid[::-1], ratios[left, j], side="right")
                        yield x, j, notch, np.where(clean[left], -10, 1)

        return tally(held, cells)

    steps = paths(grids, worths)

    def rejected(langs: np.ndarray, ordering: np.ndarray, clean: np.ndarray, ratios: np.ndarray) -> Iterator[tuple]:
        for x, rows in groups(langs):
            yield x, 0, first_over(steps[x], ratios[rows & clean & ~ordering]), None

    over = tally(held, rejected)
    return {x: allowed(steps[x], [over[x, 0, i] for i in range(len(steps[x]) + 1)], risk, each) for x in grids}


def judge(docs: DataFrame, labels: DataFrame, columns: list[str], keep_only: bool = False, **options) -> DataFrame:
    """`columns` of docs, then BASE, base_failed, kept and failed_ratios (names joined by commas).

    A text shorter than 50 words, or of which more than half are repeats, fails; any other fails if a ratio
    reaches the cutoff of its language's stratum. Null and empty texts have no words and fail; texts of any length are
    counted whole. Rows are judged each by itself, so repeated rows agree. An empty labels table gives no cutoffs, an
    empty docs table no rows. keep_only drops what fails and gives `columns` alone. Columns of docs may have any
    names; without keep_only those named like one of the results are left out.
    """
    small_batches(docs.sparkSession)
    if not keep_only:
        columns = [c for c in columns if c not in (*BASE, "base_failed", "kept", "failed_ratios")]
    marked, cutoffs = fit(docs, labels, **options)
    infinite = [math.inf] * len(RATIOS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column(len(columns))):
                part = batch.slice(first, len(texts))
                langs = part.column(len(columns) + 1)
                m, ratios = measures(texts, marked, langs)
                limits = np.array([cutoffs.get(x or "", cutoffs.get("", infinite)) for x in langs.to_pylist()]).reshape(-1, len(RATIOS))
                over, failed = ratios >= limits, base_failed(m)
                kept = ~failed & ~over.any(1)
                whole = pa.RecordBatch.from_arrays(part.columns[: len(columns)], places)
                if keep_only:
                    yield whole.filter(pa.array(kept))
                else:
                    why = [",".join(n for n, x in zip(RATIOS, row, strict=True) if x) for row in over]
                    yield pa.RecordBatch.from_arrays([*whole.columns, *(pa.array(m[k]) for k in BASE), pa.array(failed), pa.array(kept), pa.array(why, pa.string())], [*places, *BASE, "base_failed", "kept", "failed_ratios"])

    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    places = [f"c{i}" for i in range(len(columns))]  # mapInArrow takes no name with a dot
    chosen_columns = docs.select(*(column(c).alias(p) for c, p in zip(columns, places, strict=True)))
    rows = docs.select(*(column(c).alias(p) for c, p in zip(columns, places, strict=True)), F.col("text").alias("text"), lang.alias("lang"))
    schema = StructType(chosen_columns.schema.fields)
    if not keep_only:
        for name in BASE:
            schema = schema.add(name, "long")
        schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("failed_ratios", "string")
    return rows.mapInArrow(run, schema).toDF(*columns, *schema.names[len(columns) :])
