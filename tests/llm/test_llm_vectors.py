"""Vector operators against brute force, and their defined results for awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import hnsw, topk
from souk.llm.common import TASKS_PER_CORE, block_pairs
from souk.llm.hnsw import near_duplicates
from souk.llm.topk import top_k

INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id long, embedding array<float>, score string, node string, v string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)


def _clusters(n, d=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    v = np.repeat(base, 4, axis=0) + 0.15 * rng.normal(size=(n // 4 * 4, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


AWKWARD = [(900, None), (901, []), (902, [1.0, None]), (903, [NAN, 1.0]), (904, [INF, 0.0])]


def test_top_k_equals_brute_force(spark):
    v = _clusters(240)
    v[7] = v[6]                                 # a tie
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + AWKWARD
    frame = _frame(spark, rows)
    got = sorted(map(tuple, top_k(frame, frame.where("vec_id % 20 = 0"), k=5).collect()))
    z = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    z = np.vstack([z, np.zeros((1, z.shape[1]), np.int64)])     # the empty vector scores 0
    ids = np.append(np.arange(len(v)), 901)
    want = []
    for q in range(0, len(v), 20):
        order = [j for j in np.lexsort((ids, -(z @ z[q]))) if ids[j] != q][:5]
        want += [(q, r + 1, int(ids[j]), int(z[j] @ z[q])) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_index_runs_on_small_blocks():
    rng = np.random.default_rng(4)
    v = rng.integers(-400, 400, (300, 8))
    block = topk.ImpactIndex(np.arange(300), np.zeros(300, bool), v)
    rescored = []
    best, block._best = block._best, lambda rows, *a: (rescored.append(len(rows)), best(rows, *a))[1]
    for q in rng.integers(-400, 400, (20, 8)):
        rows, _ = block.search(-1, q, 10, None)
        assert list(rows) == list(np.lexsort((np.arange(300), -(v @ q)))[:10])
    assert max(rescored) < 300


@pytest.mark.parametrize("few", [2, 1000])
def test_index_block_is_exact_for_any_stopping_point(few, monkeypatch):
    monkeypatch.setattr(topk, "FEW", few)
    monkeypatch.setattr(topk, "GROUP", 5)
    rng = np.random.default_rng(0)
    v = rng.integers(-400, 400, (300, 8))
    block = topk.ImpactIndex(np.arange(300), np.zeros(300, bool), v)
    for q in rng.integers(-400, 400, (20, 8)):
        for floor in (None, int(np.sort(v @ q)[-3])):
            rows, score = block.search(-1, q, 10, floor)
            best = np.lexsort((np.arange(300), -(v @ q)))[:10]
            need = best if floor is None else [b for b in best if v[b] @ q >= floor]
            assert list(rows[:len(need)]) == list(need)
            assert list(score) == list(v[rows] @ q)


def test_top_k_repeats_empty_and_huge(spark):
    twice = _frame(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5]), (1, [0.5]), (None, [1.0, 0.0])])
    got = [tuple(r) for r in top_k(twice, twice.where("vec_id = 0"), k=10).orderBy("rank").collect()]
    # the padded repeated row counts twice, the null id is a candidate that ranks by score
    assert [r[2:] for r in got] == [(None, 1024 * 1024), (1, 512 * 1024), (1, 512 * 1024)]
    big = 2 ** 62 + 1                           # no float in between
    large = _frame(spark, [(big, [1.0]), (big + 2, [1.0]), (None, [0.5])])
    assert [r.vec_id for r in top_k(large, large.where(f"vec_id = {big}"), k=5).orderBy("rank").collect()] == [big + 2, None]
    none = _frame(spark, [])
    assert top_k(none, none, k=3).collect() == []
    huge = _frame(spark, [(0, [3e38]), (1, [3e38])])
    assert top_k(huge, huge, k=1).first()["score"] == 2 ** 63 - 1


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "LEAST_SHARDS", 2)
    v = _clusters(200, seed=5)
    v = np.vstack([v, v[:3], v[:1]])                            # repeated rows
    rows = [(i + 10, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += AWKWARD + [(905, [0.0] * 16), (906, [1.0] + [0.0] * 7), (None, [float(x) for x in v[0]])]
    got = {r["vec_id"]: r for r in near_duplicates(_frame(spark, rows)).collect()}
    w = np.vstack([v, v[:1]]).astype(np.float64)
    ids = [i + 10 for i in range(len(v))] + [None]
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    link = w @ w.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(w))
    for _ in range(len(w)):
        label = np.minimum(label, np.where(link, label[None, :], len(w)).min(1))
    for i, key in enumerate(ids):
        assert got[key]["n_links"] == link[i].sum()
        assert got[key]["component_id"] == ids[label[i]]
        assert got[key]["kept"] == (None if key is None else key == ids[label[i]])
    for key in (900, 901, 902, 903, 904, 905, 906):
        assert tuple(got[key]) == (key, 0, key, True)


def test_near_duplicates_of_one_large_group_and_of_nothing(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=32)
    v = centre + 0.12 * rng.normal(size=(700, 32))              # far more links than a beam holds
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    got = near_duplicates(_frame(spark, rows)).collect()
    w = v.astype(np.float32).astype(np.float64)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    links = (w @ w.T >= 0.9).sum(1) - 1
    found = sum(r["n_links"] for r in got)
    assert links.sum() > 0.9 * 700 * 699 and found == links.sum()
    assert {r["component_id"] for r in got} == {0}
    assert near_duplicates(_frame(spark, [])).collect() == []


def test_audit_widens_the_beam_until_planted_twins_are_found():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 24))
    graph = hnsw.Graph(v / np.linalg.norm(v, axis=1, keepdims=True))
    graph.beam = 4
    assert graph.audit(0.9, 0.99) >= 0.99
    ids, _ = graph.search(graph.v[:500], graph.beam)
    assert (ids == np.arange(500)[:, None]).any(1).mean() >= 0.99


def test_a_group_of_thousands_loses_no_link():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    v = np.vstack([centre + 0.2 / 8 * rng.normal(size=(6000, 64)), rng.normal(size=(4000, 64)) / 8])
    v = (v[rng.permutation(len(v))] * rng.uniform(0.5, 2, (len(v), 1)))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    graph = hnsw.Graph(unit)
    assert (np.bincount(graph.links[0][graph.links[0] >= 0], minlength=len(v))[1:] > 0).all()
    assert graph.audit(0.9, 0.98) >= 0.98
    back = graph.back
    state = {"links": graph.links, "sizes": graph.sizes, "beam": graph.beam, "v": v[back], "node": back + 100,
             "copies": np.ones(len(v), np.int64)}
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert want.max() > 5000
    label = np.arange(len(v) + 100)
    for at in range(0, len(v), 4096):
        some = np.arange(at, min(len(v), at + 4096))
        got = hnsw._links_of(state, {"v": v[some], "node": some + 100}, 0.9)
        counts = got[got["links"] > 0].set_index("a")["links"].to_dict()
        assert counts == {i + 100: want[i] for i in some if want[i]}
        tree = got[got["links"] == 0]
        assert len(tree) <= len(v) + len(some)
        child, root = hnsw.star_edges(np.append(label, tree["a"]), np.append(label, tree["b"].astype("int64")))
        label = np.arange(len(label))
        label[child] = root
    member = label[100:][want > 0]
    assert len(set(member.tolist())) == 1


@pytest.mark.parametrize("seed", range(5))
def test_mask_edges_connect_what_the_mask_connects(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((40, 60)) < [0.01, 0.02, 0.05, 0.3, 0.0][seed]
    if seed == 4:                               # a long path
        i = np.arange(40)
        mask[i, i] = mask[i, i + 1] = True
    def labels(rows, cols):
        child, root = hnsw.star_edges(rows + 1000, cols)
        return dict(zip(child.tolist(), root.tolist()))
    r, c = np.nonzero(mask)
    rows, to, cols, roots = hnsw.mask_edges(mask)
    assert labels(np.append(rows, cols - 1000), np.append(to, roots)) == labels(r, c)


def test_block_pairs_are_complete_and_few_tasks(spark):
    a = spark.range(300).withColumnRenamed("id", "i").withColumn("p", F.lit("x"))
    b = spark.range(70).withColumnRenamed("id", "j")
    pairs = block_pairs(a, "i", 300, b, "j", 70)
    assert pairs.select("i", "j").distinct().count() == 300 * 70
    assert pairs.rdd.getNumPartitions() <= 2 * TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert block_pairs(a.limit(1), "i", 1, b, "j", 70).count() == 70


def test_star_edges_connect_what_the_pairs_connect():
    a, b = np.array([5, 1, 9, 9]), np.array([4, 5, 8, 9])
    child, root = hnsw.star_edges(a, b)
    assert dict(zip(child.tolist(), root.tolist())) == {4: 1, 5: 1, 9: 8}
