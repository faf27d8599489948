"""Corpus operators against brute force, the library, DuckDB and held-out labels."""

import collections
import glob
import hashlib
import json
import os
import re

import duckdb
import numpy as np
import pytest

from glyphlake.llm import html_text, language, mixing, ngram_join, quality, sentencepiece_fst, textops, tool_calls, toxicity, vector_neardup, window_index
from glyphlake.llm.shared import Scratch, connected_components
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k}" for k in range(70))
EDGE = [
    (1, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "   \n\t ", "fr", "b", 5),
    (6, "one", "fr", "a", 3), (7, "ONE", "fr", "a", 3), (8, LONG + " tail of the text", "en", None, 9), (9, "x " * 3000, "en", "c", 6000), (10, "日本 語 😀", None, "c", 6),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_as_duckdb(spark, query, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = query(spark, SF)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({sql})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["op2_collision_neardup", "op3_pfair_mix", "op4_ngram_join", "op7_tool_links", "op8_quality_cascade", "op10_window_index"])
def test_matches_duckdb(spark, name):
    from glyphlake.llm.queries import ORACLES, QUERIES

    same_as_duckdb(spark, QUERIES[name], ORACLES[name])


def test_words_and_hashes():
    texts = [x.encode() for x in ("a b  a", "", " A\x0bb\x1cc ", "é é " * 400_000)]
    counts, (h,) = textops.word_hashes(texts, lower=True)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert h[0] == h[2] == h[3] and len(set(h[5:].tolist())) == 1
    for seed in range(8):
        w = np.random.default_rng(seed).integers(0, 1 << 62, 300, dtype=np.uint64)
        w[200:260] = w[20:80]
        wide = textops.window_hashes(w, 50, seed)
        assert (wide[200:211] == wide[20:31]).all() and len(set(wide.tolist())) == len(wide) - 11


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    label = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    scratch = Scratch(spark, "test")
    got = {r["node"]: r["component"] for r in connected_components(scratch, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in links)}
    scratch.close()


def test_language(spark, edge, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op1_language_mixture(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und' and lang is not null").collect()
    assert got and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    model = language.LanguageModel.fit(docs.select("text", "lang"))
    found = {r["doc_id"]: r for r in language.language_mixture(edge, model).collect()}
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == found[5]["lang_pred"] == "und"
    en, de = (" ".join(r["text"] for r in docs.where(f"lang = '{x}'").limit(5).collect())[:3000] for x in ("en", "de"))
    mixed = language.language_mixture(spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string"), model).first()
    assert set(mixed["languages"]) == {"en", "de"} and min(mixed["proportions"]) > 0.2
    assert language.language_mixture(empty, language.LanguageModel.fit(empty.select("text", "lang"))).count() == 0


def test_toxicity(spark, edge):
    words = "idiot scum trash".split()
    clean = ["the quick fox went over hill number %d" % k for k in range(60)]
    toxic = [f"you {words[k % 3]} went over hill {k}" for k in range(30)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(clean + toxic + [None, ""])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= 60)) for k in [*range(20), *range(60, 80)]], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[k]["score"] for k in range(80, 90)]) > np.mean([got[k]["score"] for k in range(20, 60)]) + 0.2
    assert len(got) == 92 and 0 <= got[90]["score"] <= 1
    nothing = toxicity.train(docs, labels.where("toxic = 2"))
    assert {r["score"] for r in toxicity.score_toxicity(edge, nothing).collect()} == {0.0}


def test_pieces_equal_the_library(spark, edge):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = sentencepiece_fst.DEFAULT_MODEL
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    texts += ["  two  spaces ", "日本語 🙂🙂 \t\n\n x", "àé <s> </s> <0x0A>", "\x00\x01", " ", "", "ab́cd"]
    fst = sentencepiece_fst.transducer(path)
    for t in texts:
        assert fst.encode(t).tolist() == library.encode(t)
        assert fst.decode(fst.encode(t)) == t
    rows = {r["doc_id"]: r for r in sentencepiece_fst.encode_column(edge, path, check="ok").collect()}
    assert rows[3]["ids"] is None and rows[4]["ids"] == [] and all(r["ok"] in (True, None) for r in rows.values())
    back = sentencepiece_fst.decode_column(sentencepiece_fst.encode_column(edge, path), path)
    assert sorted((r["doc_id"], r["text"] or "") for r in back.collect()) == sorted((r["doc_id"], r["text"] or "") for r in edge.collect())


def test_html():
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>'</script></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></ul></nav>"
        "<div class=\"cookie-notice\">We use cookies to improve what you see here.</div><article><h1>A &amp; B</h1><p><b>First   line<br>goes&nbsp;on.<p>Short.<div class='ad'>Buy this now please</div>"
        "<p>Last <a href='x'>linked</a> words.</article><aside class=sidebar>Other things to read about</aside><div id='comments'><p>I liked this article very much indeed thanks.</div><form>Name</form><footer>&copy; us"
    )
    tree = html_text.default_tree()
    assert html_text.main_text(page, tree) == "A & B\nFirst line goes on.\nShort.\nLast linked words."
    for cut in range(0, len(page), 37):
        html_text.main_text(page[:cut], tree)
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == ""
    bare = "<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>Title here</h2><p>" + "word " * 60 + "</p><p>" + "text " * 40 + "</p></body>"
    assert html_text.main_text(bare, tree).startswith("Title here\nword")


def test_html_query(spark):
    rows = html_text.op9_html_blocks(spark, SF).collect()
    assert len(rows) == 50 and all(r["n_chars"] == len(r["text"]) for r in rows) and sum(r["n_chars"] > 0 for r in rows) == 50


def test_pfair_deviation(spark, empty):
    docs = spark.createDataFrame([(k, f"s{k % 7 if k % 3 else 0}") for k in range(4000)], "doc_id long, source string")
    weights = {f"s{k}": 10.0 * (k + 1) for k in range(7)}
    rows = mixing.pfair_mix(docs, weights=weights, block_rows=4, period=100).collect()
    assert len(rows) == 4000 and len({(r["slot"], r["place"]) for r in rows}) == 4000
    slots = {r["slot"]: r["source"] for r in rows}
    targets = dict(mixing.integer_weights([(f"s{k}", 1) for k in range(7)], weights, 100))
    done = collections.Counter()
    for t in range(max(slots) + 1):
        if t not in slots:
            break
        done[slots[t]] += 1
        assert all(abs(done[s] - (t + 1) * w / 100) < 1 for s, w in targets.items())
    assert t > 100
    assert mixing.pfair_mix(empty).count() == 0


def test_edge_tables(spark, edge, empty):
    n = edge.count()
    joined = {r["doc_id"]: r for r in ngram_join.jaccard_components(edge).collect()}
    assert joined[2]["component_id"] == 1 and joined[8]["component_id"] == 1 and joined[7]["component_id"] == 6 and joined[3]["component_id"] == 3 and joined[4]["n_shingles"] == 0
    assert ngram_join.jaccard_components(empty).count() == 0
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each_group(edge).collect()) == [1, 3, 4, 5, 6, 9, 10]
    kept = {r["doc_id"]: r["text"] for r in window_index.without_repeats(edge).collect()}
    assert 2 not in kept and kept[8] == "tail of the text" and kept[1] == LONG and kept[3] is None and kept[9] == "x " * 3000
    judged = quality.cascade(edge.withColumn("n_words", edge["doc_id"])).collect()
    assert len(judged) == n and {r["doc_id"] for r in judged if r["m"]["kept"]} == {1, 2, 8}
    assert quality.reject_low_quality(empty).columns == empty.columns and quality.reject_low_quality(empty).count() == 0
    assert vector_neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_windows_in_batches(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(80)]
    texts = {}
    for d in range(60):
        words = [f"r{x}" for x in rng.integers(0, 10_000, 90)]
        if d % 3 == 0:
            a, b = sorted(rng.integers(0, 80, 2))
            words[20:20] = passage[a:b]
        texts[d] = " ".join(words)
    texts[50] = texts[7]
    owner = {}
    for d in sorted(texts):
        w = texts[d].split()
        for i in range(len(w) - 49):
            owner.setdefault(tuple(w[i : i + 50]), d)
    want = {}
    for d, t in texts.items():
        w = t.split()
        gone = {j for i in range(len(w) - 49) if owner[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want[d] = (len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index, results = window_index.in_batches(docs, 3, fanout=1)
    assert len(index.runs) == 1
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for table in results for r in table.collect()}
    index.close()
    assert got == want


def test_near_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 16))
    x[100:140] = x[0] + 0.08 * rng.standard_normal((40, 16))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, rows_of(x[5])), (304, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in vector_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    for k in range(300):
        assert got[k]["n_links"] == close[k].sum() - 1 + (close[k, 5])
    assert got[303]["component_id"] == got[5]["component_id"] and [got[k]["n_links"] for k in (300, 301, 302, 304)] == [0] * 4


def rows_of(v):
    return [float(a) for a in v]


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 0, "a", "search", '{"query":"q","limit":3}', []), (1, 1, "b", "search", '{"limit":"x","z":1}', ["a", "gone"]), (1, 2, "c", "nope", "{}", ["d"]), (1, 3, "d", "summarise", "broken", []),
            (2, 0, "e", "search", None, ["f"]), (2, 1, "f", "search", '{"query":null,"limit":1}', ["e"]), (2, 2, None, "search", "{}", None),
        ],
        "conv_id long, turn int, call_id string, name string, arguments string, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, 1, "a", "ok"), (1, 2, "b", "fine"), (1, 9, "zzz", "lost"), (1, 4, "c", None)], "conv_id long, turn int, call_id string, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in tool_calls.link_tool_calls(calls, results).collect()}
    assert got[1, "a"]["status"] == "linked" and json.loads(got[1, "a"]["canonical"]) == {"arguments": {"query": "q", "limit": 3}, "id": "a", "name": "search", "result": "ok"}
    assert got[1, "a"]["canonical"] == json.dumps(json.loads(got[1, "a"]["canonical"]), sort_keys=True, separators=(",", ":"))
    assert got[1, "b"]["errors"] == ["type:limit", "missing:query", "extra:z"] and got[1, "b"]["unknown_dependencies"] == ["gone"]
    assert got[1, "c"]["errors"] == ["unknown_tool"] and got[1, "d"]["errors"] == ["invalid_json"] and got[1, "zzz"]["status"] == "orphan_result"
    assert got[1, "d"]["position"] < got[1, "c"]["position"] and got[2, None]["status"] == "no_id"
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0)).count() == 0


def test_html_open_tags_and_state_classes():
    tree = html_text.default_tree()
    first, second = "word " * 50, "text " * 40
    article = f"<article><p>{first}</p><p>{second}</p></article>"
    want = f"{first.strip()}\n{second.strip()}"
    assert html_text.main_text(f"<html><head><title>t</title><meta charset=utf-8><body>{article}", tree) == want
    assert html_text.main_text(f"<head><title>t</title><style>p{{}}</style>{article}", tree) == want
    assert html_text.main_text(f"<head><title>t<body>{article}", tree) == want
    for tag in ("button", "select", "textarea", "object", "svg", "noscript", "video"):
        assert html_text.main_text(f"<body><div><{tag}>Go</div>{article}", tree) == want
        assert html_text.main_text(f"<body><div><{tag}>Go</div>{article}<div><{tag}>Go</{tag}></div>", tree) == want or tag in html_text.RAW
        assert html_text.main_text(f"<body><{tag}>Go{article}</body>", tree) == want
    assert html_text.main_text(f"<body><div><script>var a = 1</div>{article}", tree) == want
    assert html_text.main_text(f"<body><script>var a = '</article></body>'</script>{article}", tree) == want
    for name in ("has-sidebar", "with-footer", "nav-open"):
        assert html_text.main_text(f"<body class='{name}'><div class='{name}'>{article}</div></body>", tree) == want
        assert html_text.main_text(f"<body class='{name}'><div class='{name}'><p>{first}</p><p>{second}</p></div></body>", tree) == want
    assert html_text.main_text(f"<body><div class='sidebar-wrap'>{article}</div></body>", tree) == want
    assert html_text.main_text(f"<body>{article}<div class=comments><article><p>{second}</article></div><aside><article>{second}</article></aside></body>", tree) == want
