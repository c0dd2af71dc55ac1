"""Joins and searches against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracequarry.llm import hamming, ngram_join, nn_descent
from tracequarry.llm.components import connected_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = "".join(c if c not in "\t\n\v\f\r" else " " for c in (text or "").translate(UPPER)).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            least[x] = min(doc, least.get(x, doc))
    return [(doc, len(s), least.get(x)) for (doc, _), s, x in zip(rows, sets, label)]


def near_rows(seed, groups, hub):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    rows = [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "one two three"), (None, "one two"), (906, "É é x y z w"), (907, "é é x y z w")]
    passage = [word() for _ in range(60)]
    for g in range(groups):
        base = [word() for _ in range(r.choice([8, 30, 120]))] + (passage if g % 3 == 0 else [])
        for _ in range(hub if g == 0 else r.randint(1, 4)):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "SUBTREE", block)
    rows = near_rows(block, 60, 90)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, size int")
    found = [tuple(r) for r in ngram_join.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted(brute_classes(rows), key=str)


def test_tree_links_equal_all_pairs():
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 1 << 62, 400)
    sets = [np.unique(rng.choice(pool[k * 20 : k * 20 + 60], rng.integers(40, 60))) for k in rng.integers(0, 17, 150)]
    sizes, offsets = np.array([len(s) for s in sets]), np.cumsum([0] + [len(s) for s in sets])
    for side in (None, rng.integers(0, 2, len(sets))):
        got = ngram_join.linked(sizes, np.concatenate(sets), offsets, side)
        label = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 9 * both >= 4 * (sizes[i] + sizes[j]) and (side is None or side[i] != side[j]):
                    label[label == max(label[i], label[j])] = min(label[i], label[j])
        same = lambda x: x[:, None] == x[None, :]
        assert (same(got) == same(label)).all()


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_and_repeated_ids_between_texts(spark):
    w = [f"w{i}" for i in range(40)]
    near = lambda *at: " ".join("x" if i in at else t for i, t in enumerate(w))
    # Only the text without an id links the other two; id 9 stands at an unrelated text as well.
    rows = [(9, near(0, 1, 2)), (None, near()), (4, near(37, 38, 39)), (9, "another text of quite other words"), (2, near(20, 10, 30))]
    found = [tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found, key=str) == sorted(brute_classes(rows), key=str)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    found = dict(map(tuple, connected_components(links).collect()))
    assert found == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def vectors(seed, many, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    x = centres[rng.integers(0, 5, many)] + rng.normal(size=(many, dims)) * 0.6
    x[10:60] = x[10]
    return x


def table(spark, x):
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(5000, None, "c"), (5050, [], "c"), (5100, [None] * x.shape[1], "c"), (5150, [float("nan")] * x.shape[1], "c"), (None, x[0].tolist(), "c"), (5200, [1.0], "c")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")


def nearest_codes(rows, queries, k):
    """query, rank, id, distance over (id, code) rows, by all pairs; an id counts at its nearest code."""
    out = []
    for q in sorted(set(queries)):
        own = [c for i, c in rows if i == q]
        best = {}
        for i, c in rows:
            if i is not None and i != q:
                best[i] = min(best.get(i, 1 << 30), *(int(np.bitwise_count(np.frombuffer(c, np.uint8) ^ np.frombuffer(o, np.uint8)).sum()) for o in own))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])]
    return out


def test_hamming_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hamming, "CUT_CODES", 3)
    x = vectors(1, 500)
    codes = hamming.sign_codes(table(spark, x), "vec_id", "embedding")
    rows = [(r.id, bytes(r.code)) for r in codes.collect()]
    assert sorted(i for i, _ in rows) == list(range(500))
    found = sorted(map(tuple, hamming.top_k(codes, 7, F.col("id") % 50 == 0).collect()))
    assert found == nearest_codes(rows, range(0, 500, 50), 7)
    assert len(hamming.top_k(codes.where("id < 3"), 7, F.col("id") == 0).collect()) == 2
    assert hamming.top_k(codes.limit(0), 7, F.col("id") == 0).count() == 0


def test_hamming_of_repeated_ids_nulls_and_long_codes(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (6, 20), np.uint8)
    rows = [(int(i), bytes(base[rng.integers(0, 6)] ^ (1 << rng.integers(0, 8, 20)).astype(np.uint8) * (rng.random(20) < 0.3))) for i in rng.integers(0, 40, 120)]
    given = [(*r, "x") for r in rows] + [(None, rows[0][1], "x"), (0, None, "x"), (0, b"", "x"), (0, b"short", "x")]
    codes = spark.createDataFrame(given, "id long, code binary, distance string")
    found = sorted(map(tuple, hamming.top_k(codes, 5, F.col("id") % 4 == 0).collect()))
    assert found == nearest_codes(rows, [i for i, _ in rows if i % 4 == 0], 5)


def test_hamming_probes_few_codes(spark):
    rng = np.random.default_rng(6)
    centres = rng.integers(0, 2, (60, 64))
    bits = centres[rng.integers(0, 60, 3000)] ^ (rng.random((3000, 64)) < 0.03)
    rows = [(i, bytes(b)) for i, b in enumerate(np.packbits(bits.astype(np.uint8), axis=1))]
    codes = spark.createDataFrame(rows, "id long, code binary")
    sizes = hamming.segment_sizes(64, 3000)
    parts = codes.select(F.array("id").alias("ids"), hamming.segments(hamming.bit_text(F.col("code"), 8), sizes).alias("parts"), "code")
    buckets = hamming.bucket_table(parts.select("parts", "ids"))
    asked = parts.where("ids[0] % 50 = 0").select(F.col("code").alias("query"), F.col("parts").alias("own"), F.lit(None).cast("int").alias("bound"))
    # Nearly all of a cluster's codes are known after radius 1; a scan would verify 60 times 3000 codes.
    probed = sum(hamming.probes(asked, sizes, r).join(buckets, ["segment", "value"]).select(F.sum(F.size("codes"))).first()[0] for r in (0, 1))
    assert probed < 0.15 * 60 * 3000
    found = hamming.top_k(codes, 10, F.col("id") % 50 == 0).count()
    assert found == 600


def test_hamming_never_broadcasts_probes(spark):
    codes = spark.createDataFrame([([i, i % 7], [i]) for i in range(64)], "parts array<long>, ids array<long>")
    buckets = hamming.bucket_table(codes)
    asked = codes.select(F.lit(b"q").alias("query"), F.col("parts").alias("own"), F.lit(None).cast("int").alias("bound"))
    found = hamming.opened(hamming.probes(asked, [8, 8], 2), buckets.select("segment", "value", "cuts").distinct(), buckets)
    assert "Broadcast" not in found._jdf.queryExecution().toString()


def test_nn_descent_recall(spark):
    x = vectors(2, 1200)
    x[1199] = 0
    found = nn_descent.top_k(table(spark, x), 5, "vec_id", "embedding", F.col("id") % 50 == 0).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    hits = 0
    for q in range(0, 1200, 50):
        near = unit @ unit[q]
        near[1199] = -2
        best = [i for i in np.lexsort((np.arange(1200), -near.round(12))) if i != q][:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(near[i] - s) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & set(best))
    assert hits / (24 * 5) >= 0.9
    few = nn_descent.top_k(table(spark, x).where("vec_id < 3"), 5, "vec_id", "embedding", F.col("id") == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]
    assert nn_descent.top_k(table(spark, x).limit(0), 5, "vec_id", "embedding", F.col("id") == 0).count() == 0


def test_nn_descent_goes_on_until_settled(spark, monkeypatch):
    for name, value in {"DEGREE": 12, "TREES": 2, "BLOCK": 4, "REVERSE": 12, "BEAM": 48, "EXPAND": 1}.items():
        monkeypatch.setattr(nn_descent, name, value)
    nodes, dimension = nn_descent.unit_nodes(table(spark, vectors(4, 1500)), "vec_id", "embedding", 6)
    graph = nn_descent.build_graph(nodes, dimension)
    edges = {(r.node, r.other) for r in graph.collect()}
    again = {(r.node, r.other) for r in nn_descent.descend(graph, nodes).collect()}
    assert len(again - edges) <= 0.002 * len(again)
    # The walk ends where no neighbour of its beam is nearer than what the beam holds.
    starts = nodes.where("node = 0").select(F.lit(-1).cast("long").alias("query"), "node").crossJoin(nodes.where("node = 700").select("unit"))
    beam = {r.node: r.near for r in nn_descent.greedy_search(starts, graph, nodes).collect()}
    unit = {r.node: np.frombuffer(r.unit, np.float32) for r in nodes.collect()}
    links = [(r["at"], r.node) for r in nn_descent.around(graph).collect()]
    beyond = {b for a, b in links if a in beam} - set(beam)
    assert len(beam) > 5 and all(unit[b] @ unit[700] <= min(beam.values()) + 1e-6 for b in beyond)


def test_nn_descent_skips_pairs_that_met_before(spark, monkeypatch):
    for name, value in {"DEGREE": 12, "TREES": 2, "BLOCK": 4, "REVERSE": 12, "GATHERED": 40}.items():
        monkeypatch.setattr(nn_descent, name, value)
    nodes, dimension = nn_descent.unit_nodes(table(spark, vectors(4, 400)), "vec_id", "embedding", 6)
    graph, pairs, all_pairs, counts = nn_descent.first_graph(nodes, dimension, nodes.count()), None, None, []
    for _ in range(3):
        edges = nn_descent.edges_of(graph)
        pairs = nn_descent.marked(edges, pairs)
        all_pairs = nn_descent.marked(edges, None)
        counts.append((pairs.where("new").count(), all_pairs.where("new").count()))
        graph, whole = nn_descent.compared(graph, nodes, pairs), nn_descent.compared(graph, nodes, all_pairs)
        rows = lambda g: sorted((r.node, r.other, round(r.near, 5), r.fresh) for r in nn_descent.edges_of(g).collect())
        assert rows(graph) == rows(whole)
    assert counts[0][0] == counts[0][1] and counts[2][0] < counts[2][1]
