import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import ann_partition, mixing, packing, queries
from trailmark.llm.common import table
from trailmark.llm.quality_gam import fit, score


def brute_force(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = ann_partition.unit(np.array([v for _, v in rows], dtype=float))
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_small_table_is_exact(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_force([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    got = {}
    for r in queries.op4_ann_partition(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_recall_with_several_parts(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * 0.6).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(400)]  # one very common vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann_partition.search(df, F.col("vec_id") % 50 == 0, fit_rows=1500, rows_per_part=300, chunk_rows=200)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_force(rows)
    assert np.mean([len(got.get(q, set()) & {i for i, _ in v}) / 5 for q, v in want.items()]) >= 0.9
    assert sorted(got[0]) == [3000, 3001, 3002, 3003, 3004]


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [1e200, 0.0]), (None, [1.0, 0.0]), (100, [1e-200, 1e-200]), (0, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann_partition.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 6)))
    assert got == {0: [(1, 8, 1.0), (2, 1, 0.707107), (3, 100, 0.707107)], 100: [(1, 1, 1.0), (2, 0, 0.707107), (3, 8, 0.707107)]}
    assert ann_partition.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann_partition.search(df.where("vec_id = 7"), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(12)
    once = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    want = brute_force(once)
    close = next(j for j, _ in want[0])
    near = [(close, [c + e for c in dict(once)[close]]) for e in (1e-3, -1e-3, 2e-3, -2e-3, 3e-3)]  # one id, six vectors
    for rows, ask in ((once * 2, want), (once + [r for r in once if r[0] == close] * 6, want), (once + near, want)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in ann_partition.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        assert {q: sorted(v) for q, v in got.items()} == {q: sorted(i for i, _ in v) for q, v in ask.items()}


def test_parts_are_balanced():
    x = ann_partition.unit(np.random.default_rng(3).normal(size=(600, 8)))
    label = ann_partition.balanced_parts(x, ann_partition.neighbours(x, 8), 6)
    assert np.bincount(label, minlength=6).max() <= 110


def linked_components(texts, k=5, num=80, den=100):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    holders, root = {}, list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        near = {j for x in s for j in holders.get(x, ())}
        for j in near:
            both = len(s & sets[j])
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            holders.setdefault(x, []).append(i)
    return [find(i) for i in range(len(sets))]


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    good = corpus_pipeline.quality(spark, docs, sf)
    scores = {r["doc_id"]: r["predicted"] for r in score(docs, fit(docs, table(spark, sf, "labels"))).collect()}
    kept = good.orderBy("doc_id").collect()
    assert good.columns == columns and [r["doc_id"] for r in kept] == sorted(i for i, p in scores.items() if p)

    unique = corpus_pipeline.near_duplicates(spark, good, sf)
    roots = linked_components([r["text"] for r in kept])
    want = [kept[i] for i in range(len(kept)) if roots[i] == i]
    assert unique.columns == columns and unique.orderBy("doc_id").collect() == want

    masked = corpus_pipeline.secrets(spark, unique, sf)
    plain = {r["doc_id"]: r for r in want}
    base = (r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,})", r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}")
    assert masked.columns == columns and masked.count() == len(want)
    for r in masked.collect():
        before = plain[r["doc_id"]]
        assert not any(re.search(p, r["text"]) for p in base) and r["n_chars"] == len(r["text"])
        if not any(re.search(p, before["text"]) for p in base) and "[secret]" not in r["text"]:
            assert r == before  # clean documents stay as they were
        # What is left stands in the text in the same order.
        at = 0
        for part in r["text"].split("[secret]"):
            assert before["text"].find(part, at) >= 0
            at = before["text"].find(part, at) + len(part)

    mixed = corpus_pipeline.mixture(spark, masked, sf)
    assert mixed.columns == columns
    sizes, source = {}, {}
    for r in masked.collect():
        sizes[r["doc_id"]], source[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])), r["source"]
    of = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in set(source.values())}
    named = sorted((s for s in of if s is not None), key=lambda s: s.encode()) + [s for s in of if s is None]
    weights, targets, left = dict(zip(named, [5, 2, 1] * len(named), strict=False)), {}, 1.5 * sum(of.values())
    while True:  # shares above twice a source are cut, the excess dealt anew
        free = [s for s in named if s not in targets]
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * of[s]]
        if not full:
            targets |= share
            break
        for s in full:
            targets[s], left = 2.0 * of[s], left - 2 * of[s]
    taken = dict.fromkeys(named, 0)
    for r in mixed.groupBy("doc_id").count().collect():
        assert r["count"] <= 2
        taken[source[r["doc_id"]]] += r["count"] * sizes[r["doc_id"]]
    longest = {s: max(n for i, n in sizes.items() if source[i] == s) for s in named}
    assert all(abs(taken[s] - targets[s]) <= longest[s] for s in named)
    assert {r["doc_id"]: r["text"] for r in mixed.collect()}.items() <= {r["doc_id"]: r["text"] for r in masked.collect()}.items()

    rows = corpus_pipeline.packed(spark, mixed, sf).collect()
    assert sum(r["length"] for r in rows) == sum(len(packing.encode(r["text"])) + 1 for r in mixed.collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stage_edges(spark, stage):
    rows = [(1, "a plain text of some words", "en", "s", 26), (1, "a plain text of some words", "en", "s", 26), (None, None, None, None, None), (2, "", "en", None, 0), (3, "long " * 30_000, "en", "s", 150_000)]
    docs = spark.createDataFrame([(*r, random.random()) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    sf = "/root/testdata/sf0.001"
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in stage(spark, docs, sf).select("doc_id").collect())
    scores = [r["predicted"] for r in score(docs, fit(docs, table(spark, sf, "labels"))).collect()]
    times = {(r["doc_id"] if r["doc_id"] is not None else -1, r["size"]): 0 for r in mixing.mix(docs).collect()}
    for r in mixing.mix(docs).collect():
        times[r["doc_id"] if r["doc_id"] is not None else -1, r["size"]] += r["times"]
    want = {
        "quality": sorted((-1 if r[0] is None else r[0]) for r, p in zip(rows, scores, strict=True) if p),
        "near_duplicates": [-1, 1, 2, 3],  # the repeated row once; rows without words all stay
        "secrets": [-1, 1, 1, 2, 3],
        "mixture": sorted(i for (i, _), n in times.items() for _ in range(n)),
        "packed": sorted([-1, 1, 1, 2] + [3] * -(-(len(packing.encode(rows[4][1])) + 1) // 2048)),
    }[stage.__name__]
    if stage.__name__ == "packed":
        found = {}
        for r in stage(spark, docs, sf).collect():
            found.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        texts = {i: [x[1] or "" for x in rows if x[0] == i] for i in {x[0] for x in rows}}
        for i, some in texts.items():
            ids = packing.encode(some[0]).tolist() + [packing.END_ID]
            assert sorted(x for start, part in found[i] for x in enumerate(part, start)) == sorted([*enumerate(ids)] * len(some))
        assert len(got) >= len(want)
    else:
        assert got == want
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_quality_stage_against_features_by_hand(spark):
    """The stage's decision from bins, edges and tables looked up one by one."""
    from trailmark.llm import quality_gam

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = fit(docs, table(spark, sf, "labels"))
    rows = docs.orderBy("doc_id").limit(60).collect()
    features = quality_gam.features([r["text"] or "" for r in rows])
    for r, f in zip(rows, features, strict=True):
        words = (r["text"] or "").split()
        assert f[0] == pytest.approx(np.log1p(len(r["text"] or "")))
        if words:
            assert f[10] == pytest.approx(np.mean([len(w) for w in words])) and f[11] == pytest.approx(len(set(words)) / len(words))
            assert f[14] == pytest.approx(np.mean([len(w) > 14 for w in words])) and f[15] == pytest.approx(np.mean([len(w) < 3 for w in words]))
    bins = [[int(np.searchsorted(e, f[j], side="right")) for j, e in enumerate(model.edges)] for f in features]
    assert len(model.tables) == len(model.edges) == features.shape[1]
    # A score adds up the bias, an entry a feature and an entry a pair of coarser bins.
    assert model.pair_tables and all(t.shape == (model.coarse, model.coarse) for t in model.pair_tables.values())
    got = {r["doc_id"]: r for r in score(docs, model).collect()}
    for r, row in zip(rows, bins, strict=True):
        z = model.bias + sum(float(t[b]) for b, t in zip(row, model.tables, strict=True))
        coarse = [b * model.coarse // (len(e) + 1) for b, e in zip(row, model.edges, strict=True)]
        z += sum(float(t[coarse[i], coarse[j]]) for (i, j), t in model.pair_tables.items())
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-max(-35.0, min(35.0, z)))), abs=1e-12)
        assert got[r["doc_id"]]["predicted"] == int(z >= 0)


def test_run_chains_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    want = sorted((r["doc_id"], i) for r in docs.collect() for i in packing.encode(r["text"] or "").tolist() + [packing.END_ID])
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], i) for r in rows for i in r["ids"]) == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= packing.WINDOW


def test_texts_travel_in_small_batches(spark):
    """Of 10,000 texts an executor and its workers would hold several copies at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    try:
        for own, want in (("10000", 1000), ("0", 1000), ("7", 7)):
            spark.conf.set(name, own)
            packed = packing.pack(docs, with_ids=False)
            most = docs.coalesce(1).mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "doc_id", pa.array([b.num_rows])) for b in batches), "doc_id long, text string")
            assert most.agg(F.max("doc_id")).first()[0] == want
        assert packed.agg(F.sum("length")).first()[0] == 3000 * len(packing.encode("some words")) + 3000
    finally:
        spark.conf.set(name, before)
