"""Each stage of the pipeline on odd rows, and the whole of it against brute force."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("xxhash")
pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402

WORDS = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeiou" for c in "mnrst"]
CLASHING = ["_d", "_dn", "_t", "_text", "_lang", "_key", "_row", "own", "bits", "n_words", "kept", "n_lines", "h", "row", "a b.c"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def table_of(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in rows], SCHEMA)
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs.repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(21)
    items = [sentence(r, 40), sentence(r, 25)]
    base = [sentence(r, 90) for _ in range(12)]
    texts = [b + "\nCommon line here" for b in base] + [b + " more\ncommon line here " for b in base[:6]]
    texts += [sentence(r, 60) + " " + items[0] + " " + sentence(r, 60), "too short", None, "", " \n", sentence(r, 6000), "one two three " * 40]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, sentence(r, 70)), (None, sentence(r, 70))]
    table_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, items


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, folder, name):
    path, rows, _ = folder
    stage, docs = dict(pipeline.STAGES)[name], table_of(spark, rows)
    got = stage(spark, docs, path)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    kept = got.collect()
    assert kept and all(r[f"own {c}"[4:]] == f"own {c}" for r in kept for c in CLASHING)
    assert stage(spark, docs.limit(0), path).collect() == []


def test_quality_stage_learns_from_every_labelled_row(spark, tmp_path):
    from pyspark.sql import functions as F

    n, text = 24_800, " ".join(WORDS[:55])  # the 24,000 rows that were once drawn by hash had no "vile"
    left_out = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) >= 24_000 / n * (1 << 40)
    rows = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("vile", left_out)
    rows.selectExpr("doc_id", "1 quality", "int(vile) toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = rows.select("doc_id", F.concat(F.lit(text), F.when(F.col("vile"), " vile").otherwise("")).alias("text"), F.lit("en").alias("lang"))
    kept = pipeline.quality_rules(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in rows.filter("not vile").collect())


def test_whole_pipeline_equals_brute_force(spark, folder):
    import numpy as np
    import tokenizers

    path, rows, items = folder

    def bad(t):
        w = (t or "").split()
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if three[x] > 1 for k in range(3)}
        return len(w) < 50 or 2 * len(again) > len(w)

    left = [(d, t) for d, t in rows if not bad(t)]
    seen = defaultdict(set)
    for d, t in left:
        for x in t.split("\n"):
            seen[x.strip().lower()].add(d)
    left = [(d, "\n".join(x for x in t.split("\n") if len(seen[x.strip().lower()]) < 10 or not x.strip())) for d, t in left]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in left)]
    group = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, (d, t) in zip(group, left, strict=True):
        best[g] = min(best.get(g, (True, 0, "")), (d is None, d or 0, t)) if g in best else (d is None, d or 0, t)
    left = [(None if null else d, t) for null, d, t in best.values()]
    left = [(d, t) for d, t in left if not any(x in t for x in items)]
    encoder = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter((d, tuple([*encoder.encode(t, add_special_tokens=False).ids, 2])) for d, t in left)
    pieces = defaultdict(list)
    got = pipeline.run(spark, path).collect()
    at = 0
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * 4096 + p.offset == at and len(p.ids) == 4 * p.length
        at += p.length
        pieces[at - p.length - p.start, p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert Counter((d, tuple(ids)) for (_, d), ids in pieces.items()) == want
    assert any(len(ids) > 4096 for _, ids in want) and len(want) > 10
