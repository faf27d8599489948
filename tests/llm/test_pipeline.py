"""The pipeline: planted documents through all stages, its mixing schedule by brute force, and odd tables stage by stage."""

import collections
import re

import numpy as np
import pytest

from glyphlake.llm import mixing, sentencepiece_fst, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(1)
    base = [" ".join(f"word{x}" for x in rng.integers(0, 5000, 120)) for _ in range(12)]
    near = base[0].split()
    near[60] = "changed"
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate([*base, base[0], " ".join(near), base[1] + " " + " ".join(f"verb{k}" for k in range(60)), "short", None])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    fst = sentencepiece_fst.transducer(sentencepiece_fst.DEFAULT_MODEL)
    want = {k: base[k] for k in range(12)} | {14: " ".join(f"verb{k}" for k in range(60))}
    assert {k: fst.decode(v) for k, v in got.items()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")


def test_pipeline_shares(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(4)
    n = {"big": 90, "mid": 40, "small": 5, None: 2}
    rows = [(s, " ".join(f"word{x}" for x in rng.integers(0, 5000, 90))) for s, m in n.items() for _ in range(m)]
    rows = [(k, t, "en", s, len(t)) for k, (s, t) in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(range(len(rows)))
    fst, text = sentencepiece_fst.transducer(sentencepiece_fst.DEFAULT_MODEL), {r[0]: r[1] for r in rows}
    assert all(fst.decode(r["ids"]) == text[r["doc_id"]] for r in got)
    # the schedule by brute force: in each slot, of the released blocks that which is due first
    order = sorted(n, key=lambda s: (s is not None, s or ""))
    w = dict(mixing.integer_weights([(s, n[s]) for s in order], None, mixing.PERIOD))
    total, done, chosen = sum(w.values()), collections.Counter(), []
    while any(done[s] * mixing.BLOCK < n[s] for s in n):
        free = [s for s in order if done[s] * total // w[s] <= len(chosen)]
        chosen.append(min(free, key=lambda s: -(-(done[s] + 1) * total // w[s])))
        done[chosen[-1]] += 1
    assert {(r["slot"], r["place"]): r["source"] for r in got} == {(t, p): s for t, s in enumerate(chosen) for p in range(mixing.BLOCK)}
    assert len(got) == mixing.BLOCK * len(chosen) and all(abs(done[s] - len(chosen) * w[s] / total) < 1 for s in n)
    times = collections.Counter(r["doc_id"] for r in got)
    for s in n:
        counts = [times[r[0]] for r in rows if r[3] == s]
        assert max(counts) - min(counts) <= 1
    assert sorted(times.values())[-1] > 1


def python_operators(plan: str) -> int:
    """The most Python operators on one another in one stage: so many workers a task has."""
    most, above = 0, []
    for line in plan.splitlines():
        if not (start := re.search(r"[*A-Za-z]", line)):
            continue
        depth, name = start.start(), re.sub(r"^\*\(\d+\) ", "", line[start.start() :])
        while above and above[-1][0] >= depth:
            above.pop()
        n = 0 if re.match(r"\w*Exchange", name) else (above[-1][1] if above else 0) + name.startswith(("MapInArrow", "FlatMapGroupsInArrow"))
        above.append((depth, n))
        most = max(most, n)
    return most


def test_workers_of_a_task(spark, monkeypatch):
    """A task has one Python worker, which gets 1,000 rows at once; the mixing plans have none."""
    import corpus_pipeline

    rng = np.random.default_rng(6)
    base = [" ".join(f"word{x}" for x in rng.integers(0, 5000, 120)) for _ in range(12)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate([*base, base[0], base[1] + " changed", base[2] + " " + base[3]])]
    docs = spark.createDataFrame(rows, SCHEMA)
    size, seen, put = "spark.sql.execution.arrow.maxRecordsPerBatch", [], shared.Scratch.put
    before = spark.conf.get(size)

    def look(self, df, name):
        seen.append((name, python_operators(df._jdf.queryExecution().executedPlan().toString()), int(spark.conf.get(size))))
        return put(self, df, name)

    monkeypatch.setattr(shared.Scratch, "put", look)
    for name in ("near_duplicates", "repeated_passages"):
        dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect()
    assert {"sets", "links", "scan", "windows", "stripped"} <= {name for name, n, _ in seen if n}
    assert [x for x in seen if x[1] > 1 or x[1] and x[2] > 1000] == []
    assert spark.conf.get(size) == before
    targets = [(None, 1), ("a", 2)]
    slots = mixing.period_schedule(spark, targets)
    assert [(r["source"], r["weight"], r["ordinal"], r["slot"]) for r in slots.orderBy("slot").collect()] == [("a", 2, 0, 0), (None, 1, 0, 1), ("a", 2, 1, 2)]
    stored = spark.read.schema(SCHEMA).parquet(shared.Scratch(spark, "mixed").put(docs, "docs").scratch_path)
    for table in (slots, mixing.repeat_to_targets(stored)):
        assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, k):
    """Empty tables, nulls in any column, repeated rows, further columns with clashing names."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    empty = spark.createDataFrame([], SCHEMA)
    done = stage(spark, empty, "")
    assert done.count() == 0 and (k == 4 or done.columns == empty.columns)
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(1, long, None, None, None), (1, long, None, None, None), (None, long + " x", "en", "a", 9), (2, None, "en", "a", None), (3, "", "en", "a", 0), (4, "a b", None, "b", 3), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'k' as kept_text", "1 as m", "2 as node", "3 as _row", "4 as slots")
    got = stage(spark, odd, "").collect()
    ids = collections.Counter(r["doc_id"] for r in got)
    if name == "quality_rules":
        assert ids == {1: 2, None: 1}
    elif name == "near_duplicates":
        assert ids == {1: 2, None: 2, 2: 1, 3: 1, 4: 1}
    elif name == "repeated_passages":
        assert ids == {1: 2, None: 2, 2: 1, 3: 1, 4: 1}
    else:
        assert set(ids) == {1, None, 2, 3, 4}
    if k < 4:
        assert set(got[0].asDict()) == set(odd.columns)
