"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram's vector is the product of its letters' vectors, each
rotated by its place; a text's vector is the sum over its n-grams, a language's the sum over its texts. Sums
are linear, so a profile is built from n-gram counts, and a text's products with all profiles from one table of
each n-gram's products with them. The cosine divides by the text's norm as it is expected for random n-gram
vectors, sqrt(dim * sum of squared counts); that factor is the same for all languages and changes no choice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, small_batches

SYMBOLS = 64
GRAMS = SYMBOLS**3


def symbol_table() -> np.ndarray:
    """The symbol of each code point of the basic plane: 0 for what is no letter, 1-26 for a-z, the others shared out among 27-63 by code point; case is folded."""
    table = np.zeros(65536, np.uint8)
    for c in range(65536):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 2**32 % 37
    return table


TABLE = symbol_table()


def grams(text: str) -> np.ndarray:
    """The codes of a text's letter trigrams, words bounded by one blank; empty if it has no letter."""
    points = np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = TABLE[np.minimum(points, 65535)].astype(np.int32)
    if len(above := np.flatnonzero(points > 65535)):  # emoji are no letters
        s[above] = [27 + p * 2654435761 % 2**32 % 37 if chr(p).isalpha() else 0 for p in points[above].tolist()]
    s = np.concatenate([[0], s, [0]])
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]
    if len(s) < 3 or not s.any():
        return np.empty(0, np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def gram_vectors(codes: np.ndarray, dim: int, seed: int = 7) -> np.ndarray:
    """Bound vectors of trigrams: letters' vectors rotated by 2, 1 and 0 places, multiplied."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (SYMBOLS, dim))
    return np.roll(letters, 2, 1)[codes // SYMBOLS**2] * np.roll(letters, 1, 1)[codes // SYMBOLS % SYMBOLS] * letters[codes % SYMBOLS]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_numpy(zero_copy_only=False), strict=True):
                if lang not in held:
                    if len(held) == 32:  # bounds the memory of a task, whatever the number of languages
                        yield from flush()
                    held[lang] = np.zeros(GRAMS, np.int64)
                codes, n = np.unique(grams(text), return_counts=True)
                held[lang][codes] += n
        yield from flush()

    small_batches(docs.sparkSession)
    return docs.select("lang", "text").filter("lang is not null and text is not null").mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, dim: int = 2048) -> tuple[list[str], np.ndarray]:
    """(languages, products): products[code, k] is a trigram vector's product with the unit profile of language k.

    The driver gets at most languages * 64 ** 3 counts. Profiles have the mean profile taken away, so that
    what all languages share doesn't count.
    """
    rows = gram_counts(docs).toPandas()
    names = sorted(rows["lang"].unique())
    if not names:
        return [], np.zeros((GRAMS, 0), np.float32)
    used = np.unique(rows["code"].to_numpy())
    counts = np.zeros((len(names), len(used)), np.float64)
    counts[rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int), np.searchsorted(used, rows["code"].to_numpy())] = rows["n"].to_numpy(float)
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    if len(names) > 1:
        counts -= counts.mean(0)
    proto = np.zeros((len(names), dim))
    for a in range(0, len(used), 8192):
        proto += counts[:, a : a + 8192] @ gram_vectors(used[a : a + 8192], dim).astype(np.float64)
    proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-12)
    table = np.zeros((GRAMS, len(names)), np.float32)
    for a in range(0, len(used), 8192):
        table[used[a : a + 8192]] = gram_vectors(used[a : a + 8192], dim) @ proto.T.astype(np.float32)
    return names, table


def identify(docs: DataFrame, train: DataFrame, dim: int = 2048) -> DataFrame:
    """docs' columns doc_id and text's language: (doc_id, lang_pred, score).

    Learns from all rows of train with text and lang. A null text, one without a letter, and any text if nothing
    was learned, is `und` with score 0; signs, digits and emoji are no letters. Score: half of 1 plus the cosine with
    the best profile; ties go to the first language by name. Rows are judged each by itself, whole texts of any length, so
    repeated rows agree; only `text` is read for it. Other columns are ignored; an empty table gives no rows, an
    empty `train` learns nothing.
    """
    names, products = profiles(train, dim)
    table = docs.sparkSession.sparkContext.broadcast(products)  # at most 1 MB a language
    root = float(np.sqrt(dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, texts in pieces(batch.column("text")):
                for text in pc.fill_null(texts, "").to_numpy(zero_copy_only=False):
                    codes = grams(text)
                    if not len(codes) or not names:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    s = np.sort(codes)
                    runs = np.diff(np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])).astype(np.float64)
                    sums = table.value[codes].sum(0, dtype=np.float64)
                    k = int(sums.argmax())
                    langs.append(names[k])
                    scores.append(float(min(1.0, max(0.0, 0.5 + 0.5 * sums[k] / (root * np.sqrt((runs**2).sum()))))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
