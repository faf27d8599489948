"""Edge cases of the corpus operators, brute-force twins, and properties of their plans."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import html_labels, html_text, language, mixing, ngram_join, quality, sentencepiece_fst, shared, textops, tool_calls, toxicity, vector_neardup, window_index
from tests.conftest import SF

DOCS = "doc_id long, text string"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# n-gram join -----------------------------------------------------------------------------------------
def brute_join(rows, width=5, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    linked = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    n = len(rows)
    links = [[j for j in range(n) if j != i and linked(sets[i], sets[j])] for i in range(n)]
    label = [d for d, _ in rows]
    while True:
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            return {d: (len(sets[k]), len(links[k]), label[k]) for k, (d, _) in enumerate(rows)}
        label = new


def test_join_with_one_hot_gram_and_borderline_groups(spark):
    """Copies with few and many changes, all of them with one common passage, and texts that share nothing else."""
    rng = np.random.default_rng(8)
    common = [f"c{k}" for k in range(12)]
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(60):
            words = list(base)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                words[at] = f"x{rng.integers(0, 10**6)}"
            rows.append(" ".join(words + common))
    rows += [" ".join([f"r{rng.integers(0, 10**6)}" for _ in range(rng.integers(0, 40))] + common) for _ in range(60)]
    rows += [" ".join(f"p{k}" for k in range(m)) for m in range(1, 14)] + [rows[0], rows[5].upper(), "only four words here", "Only Four words here"]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in ngram_join.jaccard_components(table(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_join_splits_a_cluster_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(40, rng.integers(0, 3), replace=False):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "RUN", 64)
    got = {r["doc_id"]: (r["n_shingles"], r["n_links"], r["component_id"]) for r in ngram_join.jaccard_components(table(spark, rows)).collect()}
    assert got == brute_join(rows)


def test_join_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (5, text), (5, text), (7, "other words stand here and there"), (7, text), (None, "alone without any id at all"), (8, None), (None, None), (9, " \t ")]
    docs = table(spark, rows).selectExpr("*", "'x' as node", "1 as n", "2 as component_id")
    got = collections.Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in ngram_join.jaccard_components(docs).collect())
    assert got == collections.Counter([(None, 5, 26), (5, 5, 26), (5, 5, 26), (7, 7, 2), (7, 5, 26), (None, None, 2), (8, 8, 0), (None, None, 0), (9, 9, 0)])
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "5", "7", "7", "8", "9", "None", "None", "None"]


def test_join_of_a_very_long_text(spark):
    words = [f"w{k}" for k in range(120_000)]
    near = list(words)
    near[::400] = [f"y{k}" for k in range(300)]
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(table(spark, [(1, " ".join(words)), (2, " ".join(near)), (3, "short text of five words")])).collect()}
    assert got[2]["component_id"] == 1 and got[1]["n_links"] == 1 and got[3]["component_id"] == 3 and got[1]["n_shingles"] == 119_996


# quality -----------------------------------------------------------------------------------------------
def test_quality_expressions_hold_one_copy_of_each_measure(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole, filtered = plan(quality.op8_quality_cascade(spark, SF)), plan(quality.reject_low_quality(docs))
    for name in ("split(", "sort_array", "array_sort", "xxhash64"):
        assert 0 < filtered.count(name) <= whole.count(name)


def test_quality_of_odd_tables(spark):
    good = " ".join(f"word{k} and" for k in range(40)) + " end."
    rows = [(1, good), (2, None), (3, ""), (4, "word " * 200), (5, good), (5, good), (6, "#" * 50 + " # $ " * 60), (7, " ".join(f"W{k}AAA" for k in range(80))), (8, good + " x" * 3)]
    docs = table(spark, rows).selectExpr("*", "1 as m", "2 as quality_metrics", "3 as n_words", "4 as words")
    kept = quality.reject_low_quality(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 5, 8]
    judged = {r["doc_id"]: r["m"] for r in quality.cascade(docs).collect()}
    assert judged[2]["failed_rule"] == judged[3]["failed_rule"] == "few_words" and judged[4]["failed_rule"] == "repeated_words" and judged[7]["failed_rule"] == "shouting"
    assert judged[8]["n_repeat_words"] == 0 and judged[4]["n_repeat_words"] == 200


def test_quality_order_and_agreement_with_labels(spark):
    cheap, dear = quality.Rule("cheap", "n_words < 0"), quality.Rule("dear", "n_words < 0")
    assert [r.name for r in quality.cascade_order([(dear, 300.0, 0.2), (cheap, 2.0, 0.1)])] == ["cheap", "dear"]
    sf = "/root/testdata/sf0.01"
    found = quality.op8_quality_cascade(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0)) and n.get((1, False), 0) <= 0.01 * n[1, True]


# pieces ------------------------------------------------------------------------------------------------
def unigram_model(byte_fallback=True, rule=None):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = pb.ModelProto()
    add = lambda text, score, kind: m.pieces.add(piece=text, score=score, type=kind)
    add("<unk>", 0.0, 2)
    if byte_fallback:
        for b in range(256):
            add(f"<0x{b:02X}>", -20.0, 6)
    rng = np.random.default_rng(1)
    for k, text in enumerate(["▁", "a", "b", "c", "d", "e", "ab", "abc", "cd", "▁a", "▁ab", "bcd", "de", "▁the", "the", "ea", "é", "一"]):
        add(text, float(-2.0 - rng.random() * 5 - k / 100), 1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, byte_fallback
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, rule is not None, True
    if rule:
        other = pb.ModelProto()
        other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        m.normalizer_spec.precompiled_charsmap, m.normalizer_spec.name = other.normalizer_spec.precompiled_charsmap, rule
    return m.SerializeToString()


@pytest.mark.parametrize("fallback,rule", [(True, None), (False, None), (True, "nmt_nfkc")])
def test_unigram_models_equal_the_library(fallback, rule):
    import sentencepiece

    data = unigram_model(fallback, rule)
    library, fst = sentencepiece.SentencePieceProcessor(model_proto=data), sentencepiece_fst.transducer(data)
    rng = np.random.default_rng(2)
    texts = ["", " ", "abcd the abc", "zz top", "xyz  abcde\n一é", "ａｂｃ ﬁ ① Å", "a" * 300] + ["".join(rng.choice(list("abcde the é一z"), 30)) for _ in range(60)]
    for t in texts:
        assert fst.encode(t).tolist() == library.encode(t), t


def test_pieces_of_odd_tables(spark):
    path = sentencepiece_fst.DEFAULT_MODEL
    none = sentencepiece_fst.encode_column(table(spark, []), path)
    assert none.count() == 0 and none.columns == ["doc_id", "ids"]
    docs = table(spark, [(1, "a"), (1, "a"), (2, None), (3, "x" * 200_000)]).selectExpr("*", "'old' as ids", "7 as lattice")
    rows = sentencepiece_fst.encode_column(docs, path, check="ok").collect()
    assert [len(r["ids"]) > 0 and r["ok"] for r in rows if r["doc_id"] != 2] == [True] * 3 and rows[0]["ids"] == rows[1]["ids"] and rows[0]["lattice"] == 7
    lost = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(path))
    lost.adjacent.accepts = lambda before, label: False
    assert lost.path("hello") == sentencepiece_fst.transducer(path).path("hello") and sentencepiece_fst.shortest_path("hello", lost.pieces, lost.adjacent) is None


def test_worker_memory_of_pieces(spark):
    """A chunk is kept once, and whole texts reach a worker in small batches without a change of the caller's session."""
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.read_model(sentencepiece_fst.DEFAULT_MODEL))
    fst.allow(3, 100)
    first = fst.encode("one two three four").tolist()
    assert fst.kept.before and fst.encode("one two three four one").tolist()[: len(first)] == first
    assert not fst.kept.keys() & fst.kept.before.keys()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    found = sentencepiece_fst.op5_sentencepiece(spark, "/root/testdata/sf0.001")
    assert found.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert int(found.sparkSession.conf.get(name)) == sentencepiece_fst.BATCH_ROWS <= 1000 and spark.conf.get(name) == before
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()

# language, toxicity --------------------------------------------------------------------------------------
def test_language_of_a_text_does_not_depend_on_its_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.LanguageModel.fit(docs.select("text", "lang"))
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    texts += [a[:600] + b" " + b[:400] for a, b in zip(texts[::3], texts[1::3])]
    together, alone = model.proportions(texts), np.concatenate([model.proportions([x]) for x in texts])
    assert (together == alone).all()


def test_language_by_brute_force():
    """EM and the choice of languages written out word by word, on a small model."""
    rng = np.random.default_rng(5)
    model = language.LanguageModel(["x", "y", "z"], np.log(rng.dirichlet(np.full(language.BUCKETS, 0.01), 3).clip(1e-9)).astype(np.float32))
    texts = [" ".join(f"w{a}q" for a in rng.integers(0, 30, n)).encode() for n in (1, 3, 40, 200)]

    def em(like, share):
        for _ in range(model.rounds):
            post = like * share
            new = (post / post.sum(1, keepdims=True)).mean(0)
            stop = np.abs(new / new.sum() - share).max() < 1e-3
            share = new / new.sum()
            if stop:
                break
        return share, np.log((like * share).sum(1)).sum()

    for text, got in zip(texts, model.proportions(texts)):
        (_, logs), = list(model._words([text]))
        like = np.exp((logs - logs.max(0)).T.astype(float))
        price = model.penalty * 0.5 * np.log(len(like) + 1.0)
        share, fit = em(like, np.full(3, 1 / 3))
        best = share.argmax()
        if fit - np.log(like[:, best]).sum() < price * ((share > 0).sum() - 1):
            share = np.eye(3)[best]
        while (share > 0).sum() > 1:
            trial = share.copy()
            trial[np.where(trial > 0, trial, 2).argmin()] = 0
            trial, now = em(like, trial / trial.sum())
            if fit - now >= price:
                break
            share, fit = trial, now
        assert np.allclose(got, share, atol=1e-4)


def test_language_and_toxicity_of_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.LanguageModel.fit(docs.select("text", "lang"))
    rows = [(1, "x" * 100_000 + " the and of"), (2, "the and"), (2, "the and"), (3, None), (4, "12 34 !!")]
    odd = table(spark, rows).selectExpr("*", "'q' as lang_pred", "1 as score", "'k' as languages", "5 as predicted")
    got = language.language_mixture(odd, model).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert by[2][0] == by[2][1] and by[3] == by[4] == [("und", 0.0)] and len(got) == 5
    with pytest.raises(ValueError):
        language.LanguageModel.fit(table(spark, [(f"l{k}", "word") for k in range(language.MAX_LANGUAGES + 1)], "lang string, text string"))
    scorer = toxicity.ToxicityModel(np.zeros(toxicity.DIMENSIONS, np.float32), 0.0)
    scored = toxicity.score_toxicity(odd, scorer).collect()
    assert [r["predicted"] for r in scored] == [1] * 5 and {r["score"] for r in scored} == {0.5} and toxicity.score_toxicity(table(spark, []), scorer).count() == 0


# vectors -----------------------------------------------------------------------------------------------
def test_vector_counts_by_brute_force_and_recall(spark):
    rng = np.random.default_rng(6)
    q, o = rng.standard_normal((37, 5)), rng.standard_normal((53, 5))
    o[7], o[9] = q[3], o[8]
    assert (vector_neardup.window_counts(q, o, 0.5) == (np.abs(q[:, None] - o[None]) <= 0.5).sum(2)).all()
    # pairs just above the limit, among others
    base = rng.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((1500, 32))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = 0.9501
    pairs = np.concatenate([base, cos * base + (1 - cos * cos) ** 0.5 * other])
    rows = [(k, [float(v) for v in x]) for k, x in enumerate(pairs)]
    got = {r["vec_id"]: r["n_links"] for r in vector_neardup.near_duplicates(table(spark, rows, "vec_id long, embedding array<double>")).collect()}
    true = pairs @ pairs.T / np.linalg.norm(pairs, axis=1) / np.linalg.norm(pairs, axis=1)[:, None] >= 0.95
    want = true.sum(1) - 1
    assert want.min() >= 1 and sum(got.values()) >= 0.999 * want.sum() and all(got[k] <= want[k] for k in got)


def test_vectors_of_odd_tables(spark):
    v = [1.0, 2.0, 3.0]
    cos = 0.95
    edge = [cos, (1 - cos * cos) ** 0.5, 0.0]
    rows = [(1, v), (1, v), (2, [1.0, None, 2.0]), (3, [float("inf"), 1.0, 0.0]), (4, []), (5, [2.0, 4.0, 6.0]), (6, None), (None, v)]
    docs = table(spark, rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' as label", "1 as n_links", "2 as component_id")
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_neardup.near_duplicates(docs).collect())
    assert got == collections.Counter([(1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 3, 1), (6, 0, 6), (None, 3, 1)])
    far = table(spark, [(1, [1.0, 0.0, 0.0]), (2, edge), (3, [0.9499, (1 - 0.9499**2) ** 0.5, 0.0])], "vec_id long, embedding array<double>")
    links = {r["vec_id"]: r["n_links"] for r in vector_neardup.near_duplicates(far).collect()}
    unit = np.array([[1.0, 0, 0], edge, [0.9499, (1 - 0.9499**2) ** 0.5, 0]])
    assert links[1] == int(unit[0] @ unit[1] / np.linalg.norm(unit[1]) >= 0.95)


# pages -------------------------------------------------------------------------------------------------
def test_tree_on_pages_left_out():
    right = found = main = 0
    for k in range(len(html_labels.PAGES)):
        tree = html_text.DecisionTree(least=2).fit(*html_text.labelled_table(html_labels.PAGES[:k] + html_labels.PAGES[k + 1 :]))
        x, y = html_text.labelled_table(html_labels.PAGES[k : k + 1])
        p = tree.predict(x)
        right, found, main = right + (p & (y > 0)).sum(), found + p.sum(), main + (y > 0).sum()
    assert 2 * right / (found + main) > 0.95


def test_hidden_names_and_links():
    tree = html_text.default_tree()
    text, more = "word " * 40, "text " * 40
    want = f"{text.strip()}\n{more.strip()}"
    for gone in ("<p hidden>secret words</p>", "<div style='color:red; display: none'><p>secret</p></div>", "<span hidden>secret <span>words</span></span>", "<div aria-hidden=true>x</div>"):
        assert html_text.main_text(f"<article><p>{text}</p>{gone}<p>{more}</p></article>", tree) == want, gone
    assert html_text.main_text(f"<article><p data-hidden=1 title='hidden'>{text}</p><p>{more}</p></article>", tree) == want
    for kept in ('<div data-class="ad">', '<blockquote class="alert">', '<div class="x-related-y">', "<div class=has-ad>"):
        tag = kept[1:].split()[0]
        assert html_text.main_text(f"<article>{kept}<p>{text}</p></{tag}><p>{more}</p></article>", tree) == want, kept
    found = html_text.blocks(f"<a href=x><div>{text}</div></a><p>{more}</p><a href=y><p>{more}</p>")
    assert [b.links for b in found] == [1.0, 0.0, 0.0]


def test_pages_of_odd_tables(spark):
    assert html_text.extract_main_text(table(spark, [], "page_id long, html string")).count() == 0
    big = "<article>" + "<p>word word</p>" * 30_000 + "&amp;&lt;&#233;&eacute;&nbsp;&#x1F600;</article>"
    rows = [(1, big), (2, None), (2, None), (3, "")]
    got = html_text.extract_main_text(table(spark, rows, "page_id long, html string").selectExpr("*", "'t' as text", "2 as words")).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1].count("\n") == 30_000 and texts[1].endswith("&<éé 😀") and texts[2] == texts[3] == "" and len(got) == 4 and got[0]["words"] == 2


# windows -----------------------------------------------------------------------------------------------
def test_window_index_opened_again(spark, tmp_path):
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(d, " ".join(f"r{x}" for x in rng.integers(0, 9999, 60)) + (" " + passage if d % 2 else "")) for d in range(12)]
    first, second = table(spark, rows[:6]), table(spark, rows[6:])
    index = window_index.WindowIndex(spark, path=str(tmp_path / "index"))
    index.add(first).collect()
    again = window_index.WindowIndex.open(spark, str(tmp_path / "index"), first)
    assert len(again.runs) == 1 and len(again.texts) == 1
    got = {r["doc_id"]: r["n_removed"] for r in again.add(second).collect()}
    assert got == {d: 70 if d % 2 else 0 for d in range(6, 12)}
    again.close()


def test_windows_of_odd_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(1, text), (2, text + " tail"), (None, text), (3, None), (4, "short"), (5, text), (5, "mine " + text), (6, long), (7, long + " more"), (8, "w0 " * 200)]
    docs = table(spark, rows).selectExpr("*", "'k' as kept_text", "1 as digest", "2 as _id")
    index, results = window_index.in_batches(docs.select("doc_id", "text"), 2)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"]) for t in results for r in t.collect())
    index.close()
    assert got == collections.Counter([(1, 60, 0), (2, 61, 60), (None, 60, 0), (3, 0, 0), (4, 1, 0), (5, 60, 60), (5, 61, 60), (6, 60_000, 0), (7, 60_001, 60_000), (8, 200, 0)])
    kept = window_index.without_repeats(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()}[2] == "tail"
    index, results = window_index.in_batches(table(spark, []), 2)
    assert sum(t.count() for t in results) == 0


# shared ------------------------------------------------------------------------------------------------
def test_no_machine_local_folder_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_sections_of_long_texts():
    text = (" ".join(f"word{k}" for k in range(150_000))).encode()
    counts, (h,) = textops.word_hashes([text, b"word7"])
    assert counts.tolist() == [150_000, 1] and h[-1] == h[7] and len(set(h[:-1].tolist())) == 150_000 and json.dumps(counts.tolist())


# tool calls --------------------------------------------------------------------------------------------
CALLS = "conv_id long, turn int, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn int, call_id string, content string"


def test_calls_with_double_ids_results_and_no_conversation(spark):
    ok = '{"query":"q","limit":1}'
    calls = [(1, 0, "a", "search", ok, None), (1, 0, "a", "search", ok, None), (1, 1, "b", "search", ok, ["a", "a", None]), (None, 0, "n", "search", ok, ["b"]), (2, 0, "z", None, None, [])]
    results = [(1, 5, "b", "late"), (1, 2, "b", "first"), (1, 2, "b", "second"), (None, 0, "n", "x"), (3, 0, None, None)]
    got = tool_calls.link_tool_calls(table(spark, calls, CALLS).selectExpr("*", "1 as level", "2 as r", "3 as position"), table(spark, results, RESULTS).selectExpr("*", "4 as status")).collect()
    by = collections.Counter((r["conv_id"], r["call_id"], r["status"]) for r in got)
    assert by == collections.Counter([(1, "a", "duplicate_call"), (1, "a", "duplicate_call"), (1, "b", "linked"), (None, "n", "no_id"), (2, "z", "no_result"), (None, "n", "orphan_result"), (3, None, "orphan_result")])
    b = next(r for r in got if r["call_id"] == "b")
    assert json.loads(b["canonical"])["result"] == "first" and b["position"] == 2


def test_order_of_a_deep_chain_and_a_cycle(spark):
    calls = [(1, t, f"c{t}", "search", "{}", [f"c{t + 1}"] if t < 7 else []) for t in range(8)] + [(2, 0, "x", "search", "{}", ["y"]), (2, 1, "y", "search", "{}", ["x"]), (2, 2, "free", "search", "{}", []), (2, 3, "behind", "search", "{}", ["y"])]
    got = {(r["conv_id"], r["call_id"]): r["position"] for r in tool_calls.link_tool_calls(table(spark, calls, CALLS), table(spark, [], RESULTS)).collect()}
    assert [got[1, f"c{t}"] for t in range(8)] == [7 - t for t in range(8)] and got[2, "free"] == 0 and {got[2, k] for k in ("x", "y", "behind")} == {1, 2, 3}


def test_registered_calls_hold_forward_and_cyclic_dependencies(spark):
    calls, _ = tool_calls.calls_from_turns(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    deps = calls.select("conv_id", "turn", F.explode("depends_on").alias("d")).withColumn("on", F.expr("cast(substring_index(d, '-', -1) as int)"))
    known = deps.join(calls.select("conv_id", F.col("call_id").alias("d")), ["conv_id", "d"], "left_semi")
    assert known.where("on > turn and conv_id % 10 = 3").count() > 0 and known.where("on > turn and conv_id % 10 = 7").count() > 0


def test_whole_texts_in_calls(spark, tmp_path):
    """Arguments hold the whole text of a turn, and repeated turns are ranked as in the SQL."""
    import duckdb

    from glyphlake.llm.queries import ORACLES, QUERIES

    odd = ' \t"quoted" \\ 7 + 8 = 15, \u00e9\u4e2d\U0001f600\n'
    rows = [(c, t, "assistant" if t % 2 else "user", (f"turn {c} {t}" + odd) * (5 * c + t % 3)) for c in range(1, 9) for t in range(8)]
    rows += [(1, 1, "assistant", "zz" * 3), (1, 1, "assistant", "aa" * 6), (1, 1, "assistant", "b" * 7), (2, 1, "assistant", None), (3, 1, "assistant", "")]
    table(spark, rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said = {(c, f"c{c}-{t}"): text for c, t, role, text in rows[:64] if role == "assistant"}
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name, whole in (("op7_tool_links_all", True), ("op7_tool_links", False)):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
        found = got.collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
        if whole:
            arguments = [(r["conv_id"], r["call_id"], json.loads(r["canonical"])["arguments"]) for r in found if r["name"] and r["call_id"] not in ("c1-1", "c2-1", "c3-1")]
            assert len(arguments) == len(said) - 3 and all(said[c, k] in a.values() for c, k, a in arguments)


# mixing ------------------------------------------------------------------------------------------------
def test_mixing_of_odd_tables(spark):
    rows = [(k % 5 if k % 3 else None, "a" if k % 4 else None) for k in range(300)] + [(9, "b")] * 3
    docs = table(spark, rows, "doc_id long, source string").selectExpr("*", "'x' as block", "'y' as slot", "'z' as place", "1 as _n", "2 as weight")
    got = mixing.pfair_mix(docs, weights={"a": 3.0, "gone": 5.0}, block_rows=4, period=20)
    assert collections.Counter(r["source"] for r in got.collect()) == collections.Counter(s for _, s in rows)
    places = [(r["slot"], r["place"]) for r in got.collect()]
    assert len(set(places)) == len(places) and set(got.columns) == set(docs.columns)
    # sources that run out leave their slots empty, and the others keep theirs
    few = mixing.pfair_mix(table(spark, [(k, "big") for k in range(64)] + [(99, "small")], "doc_id long, source string"), weights={"big": 1.0, "small": 1.0}, block_rows=4, period=10).collect()
    assert len(few) == 65 and max(r["slot"] for r in few) > 16
