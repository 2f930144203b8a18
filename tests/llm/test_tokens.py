"""Sharding, packing and token files against brute force over a small table with odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from helioscope.llm import token_files as files  # noqa: E402
from helioscope.llm.packing import pack  # noqa: E402
from helioscope.llm.sharding import shard  # noqa: E402
from helioscope.llm.tokens import words  # noqa: E402

PATH = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n long, part int, shard int, ids string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = [None, "", " \n", "é́ Σς<|endoftext|> don't", "same", "same", "a " * 9000] + [" ".join(r.choice(["the", "Über,", "x1y22", "naïve", "…", "word"]) + r.choice(["", "s", "!"]) for _ in range(r.randint(1, 400))) for _ in range(120)]
    return [(i if i % 40 else None, t, 7, 1, 2, "x") for i, t in enumerate(texts)] + [(5, "same", 1, 1, 1, "y")] * 2


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ids_of(text):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_match_the_library():
    r = random.Random(1)
    letters = "aZé É\x1c\x85\xa0 Σςİ ß'sre½²ª€你😀́\n\t.,!-\x00\xad"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]
    import pyarrow as pa

    ids, n = words(PATH).encode(pa.array(texts))
    whole = tokenizers.Tokenizer.from_file(PATH)
    ends = np.cumsum(n)
    for text, a, b in zip(texts, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing(docs, rows):
    got = pack(docs, PATH, window=64).collect()
    want = sorted((-1 if d is None else d, crc(ids_of(t)), len(ids_of(t))) for d, t, *_ in rows)
    by_place = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in by_place:  # gapless, in order, at most a window
        assert r.sequence_id * 64 + r.offset == at and 0 < r.length <= 64 - r.offset
        at += r.length
    assert at == sum(n for _, _, n in want)
    whole = [r for r in got if r.length == r.doc_tokens]
    assert {(-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.length) for r in whole} <= set(want)
    texts = defaultdict(set)
    for d, t, *_ in rows:
        texts[d].add(tuple(ids_of(t)))
    for r in got:
        assert any(len(i) == r.doc_tokens and crc(i[r.start : r.start + r.length]) == r.ids_crc32 for i in texts[r.doc_id])


def test_files_round_trip(docs, rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    files.write_files(docs, path, PATH, 49408, shard_ids=3000)
    got = files.read_files(docs.sparkSession, path).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((d, len(i), crc(i)) for d, t, *_ in rows for i in [ids_of(t)]), key=key)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    s = docs.sparkSession.read.parquet(path).orderBy(F.desc("n")).first().asDict()
    whole = files.expand(files.unpacked(s["symbols"], s["width"], s["n_symbols"]), *files.grammar(s), s["base"])
    assert len(whole) == s["n"] and 8 * len(s["symbols"]) < s["width"] * s["n_symbols"] + 8 * s["width"]
    for start, n in ((17, 100), (0, 1), (s["n"] - 3, 3), (5, 0), (0, s["n"])):
        assert (files.decode_range(s, start, n) == whole[start : start + n]).all()


def test_grammar_shrinks_what_repeats():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    rules, spans, symbols = files.compress(ids, 50, least=4)
    assert len(symbols) < len(ids) / 100 and (files.expand(symbols, rules, spans, 50) == ids).all()
    rules, spans, symbols = files.compress(np.full(100_000, 7, np.uint32), 50)
    assert len(symbols) < 60 and (files.expand(symbols, rules, spans, 50) == 7).all() and spans.sum() > 0
    odd = np.array([1, 1, 1, 2, 1, 1], np.uint32)
    rules, spans, symbols = files.compress(odd, 9, least=1)
    assert (files.expand(symbols, rules, spans, 9) == odd).all()


def test_grammar_of_random_ids_leaves_no_frequent_pair():
    r = np.random.default_rng(3)
    for base in (3, 9, 70_000):
        ids = r.integers(0, min(base, 12), 3000).astype(np.uint32)
        rules, spans, symbols = files.compress(ids, base, least=5)
        assert (files.expand(symbols, rules, spans, base) == ids).all()
        codes, n = np.unique(symbols[:-1].astype(np.int64) << 32 | symbols[1:], return_counts=True)
        assert n.max() < 5
        assert all(spans[k] == len(files.expand(np.array([base + k], np.uint32), rules, spans, base)) for k in range(len(rules)))


def test_packed_values():
    r = np.random.default_rng(4)
    for width in (1, 7, 8, 9, 16, 17, 25, 32):
        v = r.integers(0, 1 << width, 3001).astype(np.uint32)
        data = files.packed(v, width)
        assert len(data) <= width * 3001 // 8 + width + 1
        assert (files.unpacked(data, width, 3001) == v).all() and (files.unpacked(data, width, 3001, 1024, 2000) == v[1024:2000]).all()


def test_sharding(docs, rows):
    got = shard(docs, shards=4, units=64).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted((-1 if d is None else d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"same")}) == 1
    assert len({r.shard for r in got if r.size == 1}) == 1


def test_shards_are_even(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 97 + 1 as int)) || id").alias("text"))
    loads = [r["b"] for r in shard(docs, shards=16).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 16 and max(loads) - min(loads) < 0.02 * min(loads)


@pytest.mark.parametrize("run", [lambda d: pack(d, PATH), shard, lambda d: files.token_files(d, PATH, 49408)])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
