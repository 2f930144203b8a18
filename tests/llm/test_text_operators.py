"""The other operators against brute force over small tables with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from functools import partial

import pytest

pytest.importorskip("xxhash")
pytest.importorskip("ahocorasick")

from helioscope.llm import html_text, near_dedup, pii, quality, shared  # noqa: E402
from helioscope.llm.components import components  # noqa: E402
from helioscope.llm.decontaminate import edit_distance, find_leaks, without_leaks  # noqa: E402
from helioscope.llm.hd_language import identify  # noqa: E402
from helioscope.llm.line_dedup import dedup_lines  # noqa: E402
from helioscope.llm.near_dedup import linked, near_duplicates  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n long, bits int, row long, fam int, h string"
WORDS = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeiou" for c in "mnrst"]


def made(spark, texts, lang="en"):
    rows = [(d, t, lang, 1, 2, 3, 4, "h") for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    long = sentence(r, 4000)
    base = [sentence(r, 120) for _ in range(6)]
    out = [None, "", " \n\t", "one two", "One\ttwo", long, long]
    for b in base:
        w = b.split()
        for k in range(9):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = "changed"
            out.append(" ".join(v) + ("\nShared  Line " if k % 2 else "\n\tshared  line"))
    return [(i, t) for i, t in enumerate(out)] + [(None, "one two"), (9, out[9])]


def test_line_dedup(spark, texts):
    got = dedup_lines(made(spark, texts), min_docs=10).collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    seen = defaultdict(set)
    for d, t in texts:
        for x in (t or "").split("\n"):
            seen[key(x)].add(d)
    gone = {k for k, v in seen.items() if k and len(v) >= 10}
    want = Counter()
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        want[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert gone == {"shared  line"}
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == want
    first = dedup_lines(made(spark, texts), min_docs=10, keep_first=True).filter("n_dropped > 0").count()
    assert first == sum(v for k, v in want.items() if k[2]) - 1


def brute_components(texts, percent=75):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        ids[find(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(texts))


@pytest.mark.parametrize("block", [750, 4])
def test_near_duplicates(spark, texts, block):
    got = near_duplicates(made(spark, texts), block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_near_duplicates_of_large_families(spark):
    r = random.Random(13)
    base, out = sentence(r, 60).split(), []
    for i in range(160):  # one large component, chains that hang on it, and copies too far away; null and repeated doc_ids
        w = list(base)
        for at in range(0, 60, 20 if i % 3 else 12) if i % 2 else [r.randrange(60)]:
            w[(at + i) % 60] = f"new{i}"
        out.append((None if i % 7 == 0 else i // 2 * 2, " ".join(w)))
    out += [(None, out[1][1])] * 5
    got = near_duplicates(made(spark, out), block=16).collect()
    want = brute_components(out)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == want
    assert 3 < len({k[2] for k in want}) < 120


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    r = random.Random(6)
    a, b, c, d = (sentence(r, 60) for _ in range(4))
    texts = [(1, a), (1, a), (2, a + " more"), (3, b), (3, a), (None, c), (None, c), (None, d), (7, d), (8, None), (8, " "), (9, d + " more")]
    got = corpus_pipeline.near_dedup(spark, made(spark, texts), "")
    assert got.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    assert Counter((x.doc_id, x.text) for x in got.collect()) == Counter([(1, a), (3, b), (None, c), (7, d), (8, None), (8, " ")])


def test_near_dedup_moves_no_text_of_what_it_keeps(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(31)
    rows = [(i if i % 9 else None, sentence(r, 30)) for i in range(300)]
    rows += [(i + 1000, rows[i][1] + " more") for i in range(0, 300, 4)]
    docs, got = made(spark, rows), {}
    monkeypatch.setattr(near_dedup, "exact_edges", partial(near_dedup.exact_edges, largest_broadcast=0))
    with_conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if all tables were large
    try:
        for most in (corpus_pipeline.MOST_CHUNKS, 0):
            monkeypatch.setattr(corpus_pipeline, "MOST_CHUNKS", most)
            kept = corpus_pipeline.near_dedup(spark, docs, "")
            got[most] = Counter((x.doc_id, x.text) for x in kept.collect()), "Exchange hashpartitioning" in kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_conf)
    want = Counter(rows[:300]) - Counter((None, rows[i][1]) for i in range(0, 300, 36)) + Counter((i + 1000, rows[i][1] + " more") for i in range(0, 300, 36))
    assert list(got.values()) == [(want, False), (want, True)]


def test_bitmaps(spark):
    ids = [0, 63, 64, 4095, 4096, 9000, 1 << 33, (5 << 33) + 77, (1 << 62) + 1]
    rows = spark.createDataFrame([(i, "a") for x in ids for i in (x, x + 1)] + [(64, "b")], "n long, _chunk string")
    got = shared.among(rows, "n", shared.bitmaps(spark.createDataFrame([(x,) for x in [*ids, 64]], "n long")))
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == sorted([(i, "a") for x in ids for i in (x, x + 1) if i in ids] + [(64, "b")])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), *[(200, i) for i in range(201, 260)]]
    got = {r.row: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 100: 90, **dict.fromkeys(range(201, 260), 200)}


def test_linked_asks_every_member():
    near = lambda i, others: abs(others - i) == 2
    assert {a: b for a, b in linked(7, near)} == {2: 0, 4: 0, 6: 0, 3: 1, 5: 1}


def test_leaks(spark):
    r = random.Random(2)
    items = [(i, sentence(r, 30 + i)) for i in range(5)] + [(8, None), (9, " ")]
    w = items[1][1].split()
    near = " ".join([*w[:10], "odd", *w[11:20], *w[21:]])
    texts = [(0, sentence(r, 300)), (1, "x " * 50 + items[0][1].upper().replace(" ", ",  ")), (2, sentence(r, 9) + "\n" + near + " tail"), (3, None), (4, ""), (5, items[2][1] + " " + items[3][1]), (None, items[4][1]), (6, " ".join(w[:15]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in find_leaks(made(spark, texts), table).collect()}
    assert got == {(1, 0): 0, (2, 1): 2, (5, 2): 0, (5, 3): 0, (None, 4): 0}
    assert got == {(x.doc_id, x.item_id): x.distance for x in find_leaks(made(spark, texts), table, block_words=70).collect()}
    assert sorted(x.doc_id for x in without_leaks(made(spark, texts), table).collect()) == [0, 3, 4, 6]


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        at = r.randrange(len(w))
        w[at : at + 1] = r.choice([[], ["odd"], [w[at], "odd"]])
    return " ".join(w)


def test_leaks_of_long_items(spark):
    r = random.Random(8)
    items = [(0, sentence(r, 1200)), (1, sentence(r, 40))]
    texts = [(i, sentence(r, 50) + " " + edited(r, items[0][1].split(), 120) + " " + sentence(r, 50)) for i in range(40)] + [(40, sentence(r, 3000))]
    got = {x.doc_id: x for x in find_leaks(made(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(range(40)) and all(x.item_id == 0 and x.distance <= 120 for x in got.values())


def test_leaks_without_hash_equal_brute_force(spark):
    import numpy as np

    r = random.Random(9)
    items = [(i, " ".join(r.choice("abcdef") for _ in range(20 + i % 2))) for i in range(4)]
    texts = [(i, " ".join(r.choice("abcdef") for _ in range(r.randrange(60))) + " " + edited(r, items[i % 4][1].split(), i % 4) + " a b" * (i % 3)) for i in range(40)]
    want = set()
    for d, t in texts:
        for i, x in items:
            w, own = np.array(t.split()), np.array(x.split())
            found = [(*edit_distance(own, w[s : s + 30], 2), s) for s in range(len(w))]
            if (best := min((k, s, s + size) for k, size, s in found))[0] <= 2:
                want.add((d, i, *best))
    got = find_leaks(made(spark, texts), spark.createDataFrame(items, "item_id long, text string"), recall=1.1).collect()
    assert {(x.doc_id, x.item_id, x.distance, x.start_word, x.end_word) for x in got} == want and len(want) > 20


@pytest.mark.parametrize("n", [20, 60, 200, 600])
def test_recall_of_edited_items(n):
    import numpy as np
    import pyarrow as pa

    r = random.Random(n)
    items = [sentence(r, n) for _ in range(8)]
    from helioscope.llm.decontaminate import Items, words_of

    index = Items(list(range(8)), items, 0.1, 0.99)
    found = 0
    for trial in range(80):
        flat, ends = words_of(pa.array([sentence(r, 40) + " " + edited(r, items[trial % 8].split(), n // 10) + " " + sentence(r, 40)]))
        import pyarrow.compute as pc

        code = pc.fill_null(pc.index_in(flat, index.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        found += any(k == trial % 8 for _, k, *_ in index.search(code, ends))
    assert found >= 78


def test_edit_distance():
    import numpy as np

    assert edit_distance(np.array([1, 2, 3, 4]), np.array([1, 3, 4, 9]), 2) == (1, 3)
    assert edit_distance(np.array([1, 2, 3]), np.array([7, 8, 9]), 1)[0] == 2


def test_quality_counts_and_bounds():
    import pyarrow as pa

    text = "a b c a b c\nx\n\nx\n \n### é"
    m, _ = quality.measures(pa.array([text, None, "", "a  b"]))
    assert [int(m[k][0]) for k in quality.BASE] == [10, 12, 3, 1, 6]
    assert [int(m[k][1]) for k in quality.BASE] == [0] * 5 and int(m["n_words"][3]) == 2
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05**0.01)) < 1e-9
    assert abs(quality.upper_bound(3, 20, 0.025) - 0.37893) < 1e-4


def test_quality_rejects_what_labels_show(spark):
    r = random.Random(1)
    clean, bad = [(i, sentence(r, 80)) for i in range(900)], [(i, " ".join(w + "###" for w in sentence(r, 80).split())) for i in range(900, 1000)]
    docs = made(spark, [*clean, *bad, (None, None), (2000, "")])
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(1000)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judge(docs, labels, ["doc_id"], risk=0.02).collect()}
    assert sum(got[i].kept for i in range(900)) >= 890 and not any(got[i].kept for i in range(900, 1000))
    assert got[None].base_failed and not got[2000].kept
    assert quality.judge(docs, labels.limit(0), ["doc_id"], keep_only=True).count() == 1000


def test_quality_judges_small_languages(spark):
    r = random.Random(3)
    toxic = lambda i: i % 10 == 0
    text = lambda i: sentence(r, 80) + " vile foul" * 4 * toxic(i)
    docs = made(spark, [(i, text(i)) for i in range(1500)]).union(made(spark, [(i, text(i)) for i in range(1500, 1560)], "de"))
    labels = spark.createDataFrame([(i, 1, int(toxic(i))) for i in range(1560)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judge(docs, labels, ["doc_id"]).collect()}
    assert not any(got[i].kept for i in range(0, 1560, 10))
    assert all(got[i].kept for i in range(1500, 1560) if not toxic(i))


def test_quality_marks_words_by_language(spark):
    text = lambda i, bad: "plain text" + f" {bad}, gift" * (i % 5 == 0)
    rows = [("en", text(i, "Foul"), i % 5 == 0) for i in range(1000)] + [("es", text(i, "malo"), i % 5 == 0) for i in range(30)] + [("de", "gift gut", False)] * 100
    marked = quality.marked_words(spark.createDataFrame(rows, "lang string, text string, toxic boolean"))
    assert marked == {"en": {"foul", "gift"}, "es": {"malo", "gift"}, "": {"foul", "malo"}}
    import pyarrow as pa

    ratios = quality.measures(pa.array(["malo foul gift x"] * 3 + [None]), marked, pa.array(["es", "en", "de", "es"]))[1]
    assert ratios[:, -1].tolist() == [0.5, 0.5, 0.5, 0] and quality.measures(pa.array(["gift"] * 2), marked, pa.array(["de", "en"]))[1][:, -1].tolist() == [0, 1]


def test_quality_sample():
    assert quality.quota([10, 500, 2000], 600) == 295 and quality.quota([10, 5], 600) == 10 and quality.quota([], 600) == 1


def test_quality_rule_as_a_whole_keeps_its_risk():
    import numpy as np

    rng, risk, error, broken = np.random.default_rng(4), 0.05, 0.2, 0
    for _ in range(120):  # three languages, one of them small; bad rows are only a little worse in every ratio
        held = []
        for lang, n in (("en", 900), ("de", 700), ("fr", 60)):
            clean = rng.random(n) < 0.7
            values = rng.normal(size=(n, len(quality.RATIOS))) + 2.0 * ~clean[:, None]
            held += [(lang, bool(o), bool(c), v) for o, c, v in zip(rng.random(n) < 0.25, clean, values, strict=True)]
        cutoffs = quality.chosen(held, risk, error)
        fresh = rng.normal(size=(20_000, len(quality.RATIOS)))  # what clean documents look like
        broken += any((fresh >= np.array(c)).any(1).mean() > risk for c in cutoffs.values())
        assert set(cutoffs) == {"", "en", "de"} and any(np.isfinite(cutoffs["en"]))
    assert broken <= 120 * error + 12  # three binomial standard errors above the promise


def test_quality_cutoffs_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(5)
    clean = rng.random((800, len(quality.RATIOS)))
    steps = [(0, 0.999), (1, 0.998), (0, 0.995), (2, 0.9), (3, 0.999)]
    got = quality.controlled(steps, clean, 0.02, 0.05)
    want, rejected = [float("inf")] * len(quality.RATIOS), set()
    for j, c in steps:
        rejected |= {i for i, row in enumerate(clean) if row[j] >= c}
        k, n = len(rejected), len(clean)
        from math import comb

        if sum(comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) > 0.05:  # k or fewer must be unlikely at the risk
            break
        want[j] = c
    assert got == want and got[0] == 0.995 and got[3] == float("inf")


def test_quality_fit_equals_brute_force_on_all_labelled_rows(spark):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    n, risk, error, r = 25_600, 0.01, 0.05, random.Random(9)  # more rows than the 24,000 that were once drawn by hash; those they left out hold "vile"
    drawn = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 40)) >= 24_000 / n * (1 << 40)
    part, vile = zip(*((x.part, x.vile) for x in spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(6)).alias("part"), drawn.alias("vile")).orderBy("id").collect()), strict=True)
    poor = [r.random() < 0.2 for _ in range(n)]
    toxic = [v or i % 50 == 0 for i, v in enumerate(vile)]
    langs = [r.choices(["en", "de", "fr"], [80, 18, 2])[0] for _ in range(n)]
    texts = [sentence(r, 52) + " vile" * v + " #" * r.randint(0, 12 if p else 3) + " X" * r.randint(0, 9 if p else 4) for v, p in zip(vile, poor, strict=True)]
    docs = spark.createDataFrame(list(zip(range(n), texts, langs, strict=True)), "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, int(not p), int(t)) for i, (p, t) in enumerate(zip(poor, toxic, strict=True))], "doc_id long, quality int, toxic int")
    marked, cutoffs = quality.fit(docs, labels, risk, error)

    assert all("vile" in marked[x] for x in ("en", "de", "fr", ""))
    m, ratios = quality.measures(pa.array(texts), marked, pa.array(langs))
    lang, part, clean = np.array(langs), np.array(part), ~np.array(poor) & ~np.array(toxic)
    used = ~quality.base_failed(m)
    want = {}
    for name in ("en", "de", ""):  # French is too small for a stratum, and so alone in "", which then takes all
        rows = used & ((lang == name) if name else True)
        a, b = rows & (part == 2), ratios[rows & (part > 2) & clean]
        grids = [np.unique(np.quantile(quality.coarse(ratios[a & ~clean, j]), np.linspace(0, 1, 64), method="lower"))[::-1] for j in range(len(quality.RATIOS))]
        over, fell, notch, want[name], going = np.zeros(a.sum(), bool), np.zeros(len(b), bool), [0] * len(grids), [float("inf")] * len(grids), True
        while True:
            gains = [[int(np.where(clean[a], -10, 1)[~over & (ratios[a, j] >= c)].sum()) for c in grid] for j, grid in enumerate(grids)]
            j = int(np.argmax([max(g) for g in gains]))
            if max(gains[j]) <= 0:
                break
            k = int(np.argmax(gains[j]))
            for c in grids[j][notch[j] : k + 1]:
                fell |= b[:, j] >= c
                going = going and quality.upper_bound(int(fell.sum()), len(b), error / 4) <= risk
                want[name][j] = float(c) if going else want[name][j]
            notch[j] = k + 1
            over |= ratios[a, j] >= grids[j][k]
    assert cutoffs == want and all(np.isfinite(c[-1]) and np.isfinite(c[0]) for c in want.values())


def test_pii_matches_the_patterns():
    r = random.Random(5)
    digits = lambda s: re.sub("[^0-9]", "", s)
    for _ in range(3000):
        t = "".join(r.choice("0123456789..@@-+ ()aA%b\né") for _ in range(r.randint(0, 60)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        assert [x for x in pii.spans(t) if x[1] < 4] == sorted(want), t


def test_pii_expands_cues(spark):
    text = "see ftp://me:pw@host.org/x, IBAN: DE89 3704 0044 0532 0130 00. account no. 12345678; " + "9" * 50_000
    found = pii.written(pii.spans(text))
    assert "url_login:4:15" in found and f"account:{text.index('DE89')}:" in found and f"account:{text.index('12345678')}:" in found
    got = {r.doc_id: r for r in pii.find_pii(made(spark, [(1, None), (2, text)])).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[1].spans == "" and got[2].n_account == 2


def test_pii_long_logins():
    word = "eyJhbGciOi.JIUzI1-" * 60
    text = f"git clone https://oauth2:{word}@host.org/x.git, then http://a/" + "b:" * 300 + "@c"
    end = text.index("@host")
    assert [x for x in pii.spans(text) if x[1] == 4] == [(10, 4, end)]
    assert word not in pii.redact(text) and "<url_login>" in pii.redact(text)
    many = "http://" * 100_000 + "u:p@h"
    assert [x for x in pii.spans(many) if x[1] == 4] == [(len(many) - 12, 4, len(many) - 2)]


def test_page_text(spark):
    page = "<html><nav>menu</nav><article><h1>A &amp; B</h1><p>one\n two<b>x</b><p>three<div class='comments'>no</div></article><footer>f</footer>"
    plain = "<body><div>Same top</div><p>{}</p><div>Same end</div>"
    rows = [(1, "http://h.org/a", page), (2, None, None), (3, "http://g.org/a", plain.format("own a")), (4, "http://g.org/b", plain.format("own b")), (5, "http://g.org/c", ""), (6, "http://x.org/", plain.format("alone"))]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\none twox\nthree" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[5].text == "" and got[3].text == "own a" and got[4].text == "own b"
    assert got[6].text == "Same top\nalone\nSame end"


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("most_pairs", [200_000, 0])
def test_lines_are_aligned_by_a_longest_common_subsequence(most_pairs):
    r = random.Random(8)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(14))] for _ in range(2))
        mark = html_text.common(a, b, most_pairs)
        kept = [x for x, m in zip(a, mark, strict=True) if m]
        rest = iter(b)
        assert all(x in rest for x in kept) and len(kept) == brute_lcs(a, b)
    assert sum(html_text.common(["x"] * 20_000 + ["y"], ["z"] + ["x"] * 20_000)) == 20_000


def test_pages_are_differenced_whatever_the_parts(spark):
    r = random.Random(12)
    rows = []
    for i in range(400):
        host, own = f"h{i % 3 if i % 2 else 0}.org", [f"own {i} {k}" for k in range(r.randrange(1, 4))]
        lines = ["Top of all", *own, "Quoted by many", "End of all"]
        body = "".join(f"<p>{x}</p>" for x in lines) if i % 4 else f"<p>Top of all</p><article>{''.join(f'<p>{x}</p>' for x in own)}<p>Quoted by many</p></article><p>End of all</p>"
        rows.append((i, None if i % 50 == 0 else f"http://{host}/p{i:03}", body, "clash", 1))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, host string, part int")
    want, order = {}, sorted((u.split("/")[2], u, i) for i, u, *_ in rows if u)
    texts = {i: [x for _, x in html_text.blocks(h)] for i, _, h, *_ in rows}
    for k, (host, _, i) in enumerate(order):
        near = next((order[m][2] for m in (k - 1, k + 1) if 0 <= m < len(order) and order[m][0] == host), None)
        shared = html_text.common(texts[i], texts[near])
        want[i] = ([x for x, s in zip(texts[i], shared, strict=True) if not s] if i % 4 else texts[i][1:-1], sum(shared))
    for i, u, *_ in rows:
        want.setdefault(i, (texts[i] if i % 4 else texts[i][1:-1], 0))
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {x.page_id: (x.text.split("\n"), x.n_shared) for x in html_text.extract(docs).collect()}
        assert got == want, parts
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_pages(spark):
    rows = [(1, "http://a.org/x", "<p>same</p>"), (1, "http://a.org/x", "<p>same</p>"), (None, "http://a.org/y", "<p>same</p><p>own"), (3, "http://b.org/", "<p>word</p>" * 30_000), (4, "http://b.org/", "<p>word</p>" * 30_000 + "<p>more"), (5, None, "<p>same</p>"), (6, "no url", "<p>same</p>")]
    got = sorted((r.page_id or 0, r.text[:9], r.n_chars, r.n_shared) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, "own", 3, 1), (1, "same", 4, 1), (1, "same", 4, 1), (3, "word\nword", 149_999, 30_000), (4, "more", 4, 30_000), (5, "same", 4, 0), (6, "same", 4, 0)]


def test_language(spark):
    r = random.Random(4)
    a, b = ["thing", "other", "where", "shall"], ["größe", "nicht", "über", "schön"]
    docs = made(spark, [(i, " ".join(r.choice(a) for _ in range(30))) for i in range(20)]).union(made(spark, [(i, " ".join(r.choice(b) for _ in range(30))) for i in range(20, 40)] + [(50, None), (51, "12 !"), (52, "WHERE")], "de"))
    got = {x.doc_id: x for x in identify(docs, docs.filter("doc_id < 40 and doc_id % 2 = 0")).collect()}
    assert all(got[i].lang_pred == ("en" if i < 20 else "de") and 0 <= got[i].score <= 1 for i in range(40))
    assert got[50].lang_pred == got[51].lang_pred == "und" and got[52].lang_pred == "en"


@pytest.mark.parametrize("run", [dedup_lines, near_duplicates, pii.find_pii, lambda d: identify(d, d), lambda d: find_leaks(d, d.select(d.doc_id.alias("item_id"), "text")), lambda d: quality.judge(d, d.selectExpr("doc_id", "1 as quality", "0 as toxic"), ["doc_id"])])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
