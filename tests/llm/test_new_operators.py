"""Periodic runs, license scans and Merkle manifests: brute-force twins, odd tables, planted cases."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import html_labels, html_text, language, license_scan, merkle_manifest, mixing, periodic_runs, queries, sentencepiece_fst, toxicity, vector_neardup
from tests.conftest import SF

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_license_scan", "op13_merkle_manifest"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    plain = lambda x: [r.replace(".0,", ",").replace(".0]", "]") for r in x]
    assert plain(rows(got)) == plain(rows(want))


# periodic runs -------------------------------------------------------------------------------------------
def brute_runs(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, size, q) for (s, size), q in out.items())


def odd_words(rng):
    n, kind = int(rng.integers(0, 150)), rng.integers(0, 5)
    if kind == 0:
        return rng.integers(0, 2, n).tolist()
    if kind == 1:
        out = []
        while len(out) < n:
            seed = rng.integers(0, 2, rng.integers(1, 12)).tolist()
            out += [seed[k % len(seed)] for k in range(rng.integers(1, 50))]
        return out
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3 and n:
        a, p = int(rng.integers(0, n)), int(rng.integers(1, n + 1))
        w = rng.integers(0, 3, n).tolist()
        return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    u = ([0, 1] if rng.random() < 0.5 else [0, 0, 1]) * int(rng.integers(1, 40))
    return u + [2] * int(rng.integers(0, 2)) + u[:: -1 if rng.random() < 0.5 else 1] + rng.integers(0, 2, rng.integers(0, 5)).tolist() + u


def test_runs_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(800):
        texts = [odd_words(rng) for _ in range(rng.integers(1, 5))]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        got = zip(*[x.tolist() for x in periodic_runs.find_runs(np.array(sum(texts, []), np.int64), owner)])
        starts = np.cumsum([0, *[len(w) for w in texts]])
        assert list(got) == [(s + int(at), size, q) for at, w in zip(starts, texts) for s, size, q in brute_runs(w)]


def test_candidates_in_small_portions(monkeypatch):
    monkeypatch.setattr(periodic_runs, "AT_ONCE", 3)
    words = ([0, 1] * 40 + [2] + [0, 1] * 40) * 3
    got = periodic_runs.find_runs(np.array(words), np.zeros(len(words), int))
    assert list(zip(*[x.tolist() for x in got])) == brute_runs(words)


def test_wavelet_tree_against_sorting():
    rng = np.random.default_rng(1)
    values = rng.permutation(700)
    tree = periodic_runs.WaveletTree(values)
    left = rng.integers(0, 700, 300)
    right = left + rng.integers(1, 50, 300).clip(max=700 - left)
    limit = rng.integers(0, 800, 300)
    below = tree.below(left, right, limit)
    assert below.tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(left, right, limit)]
    k = (rng.random(300) * (right - left)).astype(int)
    assert tree.smallest(left, right, k).tolist() == [int(np.sort(values[a:b])[j]) for a, b, j in zip(left, right, k)]


def test_runs_of_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_WORDS", 64)
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, "a b " * 9), (1, "a b " * 9), (None, "x\t" * 12), (2, None), (3, ""), (4, " \n "), (5, "x " * 11), (6, long + " z" * 40), (7, "é é " * 12)]
    docs = docs_of(spark, rows).selectExpr("*", "1 as runs", "2 as collapsed", "3 as n_words")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()]
    found = {}
    for r in got:
        found.setdefault(r[0], []).append(r[1:])
    assert found[1] == [(18, [(0, 18, 2)], "a b")] * 2 and found[None] == [(12, [(0, 12, 1)], "x")]
    assert found[2] == found[3] == found[4] == [(0, [], "")] and found[5] == [(11, [], " ".join(["x"] * 11))]
    assert found[6] == [(30_040, [(30_000, 40, 1)], long + " z")] and found[7] == [(12, [(0, 12, 1)], "é é")]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(5, int), np.zeros(5, int), 3)


def test_planted_texts(spark):
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(k % 50))) for k in range(300)] + [(None, "a b c"), (12, None)]
    got = {r["doc_id"]: r["text"] for r in periodic_runs.planted(docs_of(spark, rows)).collect()}
    for k, text in rows[:12] + rows[13:-2]:
        words, h = text.split(), zlib.crc32(str(k).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        assert got[k] == text
    assert got[None] == "a b c"


# licenses ------------------------------------------------------------------------------------------------
def brute_matches(text, percent=license_scan.PERCENT, templates=license_scan.TEMPLATES):
    words = [w.decode() for w in license_scan.WORD.findall((text or "").lower().encode())]
    found = set()
    for k, (label, template) in enumerate(templates):
        wanted, half = set(template.split()), 1 << max(0, len(template.split()) - 1).bit_length()
        for first in range(0, len(words), half):
            block = words[first : first + 2 * half]
            common = len(wanted & set(block))
            if 100 * common >= percent * len(wanted):
                found.add((label, k, first, first + len(block) - 1, common, len(wanted)))
    sets = [set(t.split()) for _, t in templates]
    return sorted(x for x in found if not any(y[2:4] == x[2:4] and sets[x[1]] < sets[y[1]] for y in found))


def license_rows():
    rng = np.random.default_rng(4)
    words = [w for _, t in license_scan.TEMPLATES for w in t.split()] + [f"p{k}" for k in range(40)]
    rows = []
    for k in range(120):
        parts = [" ".join(rng.choice(words, rng.integers(0, 80)))]
        for _ in range(rng.integers(0, 3)):
            notice = license_scan.TEMPLATES[rng.integers(0, len(license_scan.TEMPLATES))][1].split()
            drop = rng.integers(0, len(notice)) if rng.random() < 0.5 else None
            parts += [", ".join(w.title() for i, w in enumerate(notice) if i != drop), " ".join(rng.choice(words, rng.integers(0, 60)))]
        rows.append((k, ".\n".join(parts)))
    return rows


def test_license_join_equals_brute_force(spark):
    rows = license_rows()
    got = {r["doc_id"]: [tuple(x) for x in r["matches"]] for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    want = {k: brute_matches(t) for k, t in rows}
    assert got == want and sum(map(len, want.values())) > 60


def test_license_places_and_odd_tables(spark):
    line = "This work is licensed under the GNU General Public License, version 3."
    lesser = "Licensed under the GNU Lesser General Public License, version 3"
    rows = [
        (1, "under-the MIT\nLicense. Under the mit license"), (1, "under-the MIT\nLicense. Under the mit license"), (None, "CC BY-NC 4.0"), (2, None), (3, ""), (4, "... \x00"),
        (5, line), (6, lesser), (7, "ünder the mit license"), (8, "plain words " * 5000 + line), (9, "Under the MIT licenses"),
    ]
    docs = docs_of(spark, rows).selectExpr("*", "1 as places", "2 as matches", "3 as row", "4 as blocks")
    out = license_scan.scan_licenses(docs).collect()
    got = {r["doc_id"]: ([tuple(x) for x in r["places"]], sorted({x["label"] for x in r["matches"]}), r["n_words"]) for r in out}
    assert len(out) == len(rows)
    assert got[1] == ([("mit", 0, 3), ("mit", 4, 7)], [], 8) and got[None] == ([("cc-by-nc", 0, 2)], [], 5)
    assert got[2] == got[3] == got[4] == ([], [], 0)
    assert got[5][1] == ["gpl-3"] and got[6][1] == ["lgpl-3"] and got[8][1] == ["gpl-3"] and got[9][0] == [] and got[7][0] == []
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


def test_license_templates_are_a_parameter(spark):
    templates = (("one", "alpha"), ("two", "alpha beta gamma delta"), ("none", " "))
    docs = docs_of(spark, [(1, "alpha x x x"), (2, "delta gamma beta alpha"), (3, "x")])
    got = {r["doc_id"]: {x["label"] for x in r["matches"]} for r in license_scan.scan_licenses(docs, templates, {}, 75).collect()}
    assert got == {1: {"one"}, 2: {"two", "one"}, 3: set()}


# Merkle tree ---------------------------------------------------------------------------------------------
def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(nodes):
    """(top, path of each node) with siblings left and right by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k in range(len(nodes)):
            run = level[at[k] // 16 * 16 : at[k] // 16 * 16 + 16]
            paths[k].append(("".join(run[: at[k] % 16]), "".join(run[at[k] % 16 + 1 :])))
            at[k] //= 16
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], paths


def brute_manifest(rows):
    """rows: (doc_id, text, source, lang, n_chars); gives sorted (doc_id, leaf, subroot, root, path)."""
    by = {}
    for d, t, s, lang, n in rows:
        by.setdefault(s, []).append((d is not None, d or 0, brute_leaf(d, s, lang, n, t), d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s]), *brute_tree([x[2] for x in sorted(by[s])])) for s in sources}
    root, tops = brute_tree([trees[s][1] for s in sources])
    return sorted((str(x[3]), x[2], trees[s][1], root, str(path + top)) for s, top in zip(sources, tops) for x, path in zip(trees[s][0], trees[s][2]))


def manifest_rows(spark, rows):
    docs = docs_of(spark, rows).selectExpr("*", "1 as g", "2 as n", "3 as leaf_", "4 as rank")
    out = merkle_manifest.merkle_manifest(docs.withColumn("leaf", merkle_manifest.leaf_digest()))
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], str([tuple(p) for p in r["path"]])) for r in out.collect())


def test_tree_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(d), f"text {d}", f"s{d % 3}" if d % 7 else None, None if d % 5 else "en", int(d % 4)) for d in rng.choice(10**6, 700, replace=False)]
    rows += [(-5, "é", "s1", None, None), (-1, None, "s1", None, None), (-64, "x", "s1", None, None), (2**62, "far", "s1", "a", 1), (9, "", "only", None, None), (0, "", "", None, None), (1, "hot", "Z", None, 3)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_tree_of_many_sources_and_sparse_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), "t", f"host{k // 2}", None, 1) for k, d in enumerate(rng.integers(-(2**63), 2**63 - 1, 620))]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_tree_with_repeated_and_null_ids(spark):
    rows = [(5, "a", "s", None, 1)] * 40 + [(5, f"b{k}", "s", None, 1) for k in range(30)] + [(6, "c", "s", None, 1), (4, "d", "s", None, 1), (900, "e", "s", None, 2)]
    rows += [(None, "n", "s", None, 1)] * 20 + [(None, f"m{k}", "s", None, 1) for k in range(20)] + [(None, "n", None, None, None)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_tree_of_one_row_and_none(spark):
    leaf = brute_leaf(3, "s", None, None, "t")
    assert manifest_rows(spark, [(3, "t", "s")]) == [("3", leaf, leaf, leaf, "[]")]
    assert manifest_rows(spark, []) == []


def test_folding_finds_a_change(spark):
    rows = [(k, f"Text {k}", f"s{k % 2}", None, None) for k in range(50)]
    docs = docs_of(spark, rows).withColumn("leaf", merkle_manifest.leaf_digest())
    tree = merkle_manifest.merkle_manifest(docs.withColumn("other", merkle_manifest.leaf_digest(text=F.lower("text"))), ("other",))
    got = tree.select((merkle_manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("same"), (merkle_manifest.fold(F.col("other"), F.col("path")) == F.col("root")).alias("changed")).collect()
    assert all(r["same"] for r in got) and not any(r["changed"] for r in got) and len(got) == 50


# main text -----------------------------------------------------------------------------------------------
LONG = "The river rose by two metres in a single night and the lower town was cut off from the road until the army brought boats."


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<article><h1>News</h1><p>{LONG}</p><p>Finis.</p></article>", ["News", LONG, "Finis."]),
        ("<article><p>Gone.</p></article>", ["Gone."]),
        (f"<main><p>{LONG}</p><table><tr><td>42</td></tr></table></main>", [LONG, "42"]),
        (f"<article><p class='advert'>Buy</p><p>{LONG}</p><ul><li class=ad>Buy two</li><li>Two dead</li></ul><p id='cookie-notice'>We use cookies</p></article>", [LONG, "Two dead"]),
        (f"<article><blockquote class='site-notice'>Closed today</blockquote><p>{LONG} <span class=ad>Buy!</span>Done.</p></article>", [f"{LONG} Done."]),
        (f"<article><section class='related-work'><p>{LONG}</p></section><div class='share-price'><p>Up again.</p></div><div class=footnote>1</div></article>", [LONG, "Up again.", "1"]),
        (f"<article><p style='visibility: hidden'>no</p><p>{LONG}</p></article><section><h2>You say</h2><p>{LONG} Never.</p><p>me too</p></section>", [LONG]),
        (f"<header><h1>The Daily</h1></header><h1>River</h1><article><p>{LONG}</p></article>", ["River", LONG]),
    ],
)
def test_main_text_of_contract_cases(page, want):
    assert html_text.main_text(f"<body>{page}</body>", html_text.default_tree()).split("\n") == want


def test_main_text_of_unseen_labelled_pages():
    tree = html_text.default_tree()
    x, y = html_text.labelled_table(html_labels.labelled_pages(200, seed=7)[len(html_labels.PAGES) :])
    found = tree.predict(x)
    assert 2 * (found & (y > 0)).sum() / (found.sum() + y.sum()) > 0.97
    inside = (x[:, html_text.FEATURES.index("main")] > 0) & (x[:, html_text.FEATURES.index("boiler_tag")] + x[:, html_text.FEATURES.index("boiler_name")] == 0)
    assert found[inside].all()  # no block of the article goes for its length


@pytest.mark.parametrize("piece", ["<div>", "<div></ul>", "<p class=x>", "<div><button>", "<a href=x>", "<div hidden><select>"])
def test_time_grows_with_the_page(piece):
    import time

    tree, size = html_text.default_tree(), 300_000 // len(piece)
    start = time.perf_counter()
    html_text.main_text(piece * size, tree)
    assert time.perf_counter() - start < 3


def test_main_text_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, f"<article><p>{LONG}</p></article>", "x", 2)], "page_id long, html string, TEXT string, `a.b` int")
    out = html_text.extract_main_text(pages)
    assert out.columns == ["page_id", "a.b", "text"] and out.collect()[0] == (1, 2, LONG)


# vectors -------------------------------------------------------------------------------------------------
def test_sketches_lose_no_collision():
    rng = np.random.default_rng(3)
    rules = vector_neardup.Projections(5000)
    x = vector_neardup._unit(rng.standard_normal((300, 32)))
    y = vector_neardup._unit(x[:200] + 0.05 * rng.standard_normal((200, 32)))
    fine, rough = vector_neardup.window_counts(x @ rules.directions(32)[1], y @ rules.directions(32)[1], rules.window), None
    a, b = (rules.sketches(v).astype(np.int16) for v in (x, y))
    rough = vector_neardup.sketch_counts(a[:, : rules.counted], b[:, : rules.counted], rules.steps)
    assert (rough >= fine).all() and (rough == vector_neardup.window_counts(a[:, : rules.counted], b[:, : rules.counted], rules.steps)).all()
    brute = (np.abs(a[:, None, : rules.counted] - b[None, :, : rules.counted]) <= rules.steps).sum(2)
    assert (rough == brute).all()


# toxicity ------------------------------------------------------------------------------------------------
def test_risk_and_slopes_against_a_plain_version():
    rng = np.random.default_rng(1)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for shift in (-2.0, 3.0):
        zp, zu, prior = rng.normal(2, 1, 30), rng.normal(-3 if shift > 0 else 0, 1, 50), 0.3
        negative = lambda a, b: sum(sigmoid(b)) / 50 - prior * sum(sigmoid(a)) / 30
        positive = lambda a: prior * sum(1 - sigmoid(a)) / 30
        got = toxicity.risk(sigmoid(zp), sigmoid(zu), prior)
        assert np.allclose(got, (positive(zp), negative(zp, zu)))
        goal = (lambda a, b: positive(a) + negative(a, b)) if got[1] >= 0 else (lambda a, b: -negative(a, b))
        assert (got[1] < 0) == (shift > 0)
        gp, gu = toxicity.slopes(sigmoid(zp), sigmoid(zu), prior)
        step = 1e-6
        for k in (0, 7):
            e = np.zeros(30)
            e[k] = step
            assert abs((goal(zp + e, zu) - goal(zp - e, zu)) / (2 * step) - gp[k]) < 1e-7
            e = np.zeros(50)
            e[k] = step
            assert abs((goal(zp, zu + e) - goal(zp, zu - e)) / (2 * step) - gu[k]) < 1e-7


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = toxicity.op6_toxicity_pu(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_toxicity_bounds_its_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"bad words {k}") for k in range(50)] + [(k, "good words here") for k in range(10, 40)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    sizes = []
    fit = toxicity.ToxicityModel.fit.__func__
    monkeypatch.setattr(toxicity.ToxicityModel, "fit", classmethod(lambda cls, p, u, prior: sizes.append((len(p), len(u))) or fit(cls, p, u, prior)))
    toxicity.train(docs, labels, max_positive=3, max_unlabelled=20)
    assert sizes == [(1, 20)]
    model = toxicity.train(docs, labels.limit(0))
    assert [r["score"] for r in toxicity.score_toxicity(docs.limit(2), model).collect()] == [0.0, 0.0]


def test_toxicity_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x", 2, 3)], "doc_id long, text string, SCORE int, `a.b` int")
    out = toxicity.score_toxicity(docs, toxicity.ToxicityModel(None, 0.0))
    assert out.columns == ["doc_id", "text", "a.b", "score", "predicted"] and out.first()["a.b"] == 3


# columns -------------------------------------------------------------------------------------------------
def test_clashing_and_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "the night the day", "en", 5, 6, 7, 8)], "doc_id long, text string, lang string, SLOT int, IDS int, Score int, `a.b` int")
    mixed = mixing.pfair_mix(docs.withColumn("source", F.lit("s")))
    assert [c for c in mixed.columns if c.lower() == "slot"] == ["slot"] and mixed.first()["slot"] == 0 and mixed.first()["a.b"] == 8
    model = language.LanguageModel.fit(docs.select("text", "lang"))
    found = language.language_mixture(docs, model)
    assert [c for c in found.columns if c.lower() == "score"] == ["score"] and found.first()["lang_pred"] == "en" and found.first()["a.b"] == 8
    if os.path.exists(sentencepiece_fst.DEFAULT_MODEL):
        pieces = sentencepiece_fst.encode_column(docs, sentencepiece_fst.DEFAULT_MODEL)
        assert [c for c in pieces.columns if c.lower() == "ids"] == ["ids"] and pieces.first()["a.b"] == 8
        assert sentencepiece_fst.decode_column(pieces.withColumn("TEXT", F.lit(1)), sentencepiece_fst.DEFAULT_MODEL).first()["text"] == "the night the day"


def test_sources_of_whole_numbers(spark):
    docs = spark.range(90).selectExpr("id as doc_id", "cast(if(id < 60, 3, 4) as int) as source")
    rows = mixing.repeat_to_targets(docs, weights={3: 1, 4: 1}, block_rows=4, period=10).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in rows}
    assert n[3] >= 60 and abs(n[3] - n[4]) < 8
    assert mixing.pfair_mix(docs, weights={3: 1, 4: 1}, block_rows=4, period=10).count() == 90
