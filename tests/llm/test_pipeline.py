"""The pipeline and its contract on the smallest tables; each stage against plain Python on a table with nulls, repeats and odd texts."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweft import runtime
from cellweft.llm import exact_dedup, jaccard_join, toxicity
from cellweft.runtime import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        counts.append(len(rows))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 1:
            texts = [(r["text"] or "").lower() for r in rows]
            assert len(set(texts)) == len(texts)
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def _odd(spark):
    """Documents of the smallest table, with copies, near copies, repeated rows, null ids and odd texts, and an extra column."""
    docs = table(spark, DATA, "documents").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1) for r in docs]
    long = next(r for r in rows if r[1] and len(r[1].split()) > 120)
    rows += [(9001, long[1].upper(), *long[2:]), (9002, long[1] + " more", *long[2:]), (9003, long[1], *long[2:]), (9003, long[1], *long[2:]), (None, long[1], *long[2:]), (None, None, None, None, None, 2)]
    rows += [(9004, None, "en", None, 0, 3), (9005, "", "en", "a", 0, 3), (9006, "word " * 30_000, "en", "a", 0, 3), (9006, "other text", "en", "a", 0, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, marked int")


def test_driver_gives_memory_back(spark, monkeypatch):
    """Training leaves nothing of its sample in the driver, and tables that are written or deleted let the JVM trim its native heap."""
    calls = []
    monkeypatch.setattr(toxicity, "release", lambda: calls.append("release"))
    docs = table(spark, DATA, "documents")
    assert toxicity.train(docs, table(spark, DATA, "labels")).landmarks and calls == ["release"]
    assert runtime.trim(spark)  # on the Java 17 used here
    monkeypatch.setattr(runtime, "trim", lambda s: calls.append("trim"))
    runtime.discard(runtime.materialize(docs.limit(1), "test"))
    assert calls == ["release", "trim", "trim"]


def test_executors_give_memory_back(spark, monkeypatch):
    """A local session is left alone; elsewhere each core gets a task, and these let the JVM that runs them collect its whole heap."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    assert runtime.relieve(spark) == 0 and full() == before
    monkeypatch.setattr(spark.sparkContext, "master", "spark://master:7077")
    assert runtime.relieve(spark) == spark.sparkContext.defaultParallelism and full() > before


def test_stages_begin_with_relief(spark, monkeypatch):
    """Executors give back what the stage before took of them: the steps of both dedup stages ask for it themselves."""
    calls = []
    for module in (corpus_pipeline, exact_dedup, jaccard_join):
        monkeypatch.setattr(module, "relieve", lambda s: calls.append(stage))
    docs = table(spark, DATA, "documents").limit(50)
    for stage, run in corpus_pipeline.STAGES:
        run(spark, docs, DATA)
        assert stage in calls


def _key(row):
    return repr(tuple(row))


def test_dedup_stages_against_plain_python(spark):
    docs = _odd(spark)
    rows = docs.collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for r in rows:
        groups.setdefault(low(r["text"]), []).append(r["doc_id"])
    keep = {max((i for i in g if i is not None), default=None) for g in groups.values()}
    dropped = {r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] != max(i for i in groups[low(r["text"])] if i is not None)}
    exact = corpus_pipeline.drop_exact_copies(spark, docs, DATA)
    assert exact.columns == docs.columns and keep
    assert sorted(map(_key, exact.collect())) == sorted(_key(r) for r in rows if r["doc_id"] not in dropped)
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", low(t)) if w]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    near_docs = docs.where("doc_id is null or doc_id != 9006")  # its two texts share an id
    rows = near_docs.collect()
    sets = {r["doc_id"]: shingles(words(r["text"])) for r in rows if r["doc_id"] is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    near = corpus_pipeline.drop_near_copies(spark, near_docs, DATA).collect()
    assert sorted(map(_key, near)) == sorted(_key(r) for r in rows if r["doc_id"] is None or find(r["doc_id"]) == r["doc_id"])
    assert len(near) < len(rows)


def test_toxicity_and_mix_stages(spark):
    docs = _odd(spark)
    rows = docs.collect()
    labels = table(spark, DATA, "labels")
    machine = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    score = lambda t: max([0.0] if not toxicity.units_of(t) else machine.probability(toxicity.unit_scores(toxicity.units_of(t), machine.weights, machine.bias)))
    kept = corpus_pipeline.drop_toxic(spark, docs, DATA).collect()
    assert sorted(map(_key, kept)) == sorted(_key(r) for r in rows if score(r["text"]) < 0.5)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").split())
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    goal, open_, left = {s: 0.0 for s in names}, set(names), float(sum(sizes.values()))
    while open_:  # targets by hand: shares by weight, none above three times its source
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        goal |= share if not over else {s: 3.0 * sizes[s] for s in over}
        if not over:
            break
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= over
    mixed = corpus_pipeline.mix(spark, docs, DATA).collect()
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
        assert r["marked"] is not None
    for s in names:
        assert abs(taken[s] - goal[s]) <= 4, s


def test_stages_of_an_empty_table(spark):
    docs = _odd(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "n_tokens" in out.columns
