"""The vector and evaluation queries against brute force on a small table: each twentieth vector asks."""

import numpy as np
import pytest

from gritstone.plans import catalog

N, KS = 90, (1, 3, 5, 10)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(N, 8)).astype(np.float32)
    x[50:65] = x[20]  # ties, more than a list holds
    label = rng.integers(0, 3, N)
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(N)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, x.astype(float), label


def lists(x, k, digits, l2=False):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in range(0, N, 20):
        score = 1 / (1 + ((x - x[q]) ** 2).sum(1)) if l2 else unit @ unit[q]
        out[q] = sorted((-round(float(score[i]), digits), i) for i in range(N) if i != q)[:k]
    return out


def test_vector_lists(spark, table):
    path, x, _ = table
    for name, l2 in (("vector_topk_l2", True), ("vector_topk_cosine", False)):
        got: dict = {}
        for r in catalog.QUERIES[name](spark, path).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        want = lists(x, 10, 6, l2)
        assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
        assert all(np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-9) for q in want)


def test_mmr(spark, table):
    path, x, _ = table
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got: dict = {}
    for r in catalog.QUERIES["mmr_select"](spark, path).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert sorted(got) == list(range(0, N, 20))
    for q, near in lists(x, 24, 12).items():
        score, taken = {i: -s for s, i in near}, []
        while len(taken) < 10:
            value = {i: 0.7 * score[i] - 0.3 * max([0.0, *(float(unit[i] @ unit[j]) for j in taken)]) if taken else score[i] for i in sorted(score) if i not in taken}
            taken.append(max(value, key=lambda i: (round(value[i], 9), -i)))
        assert [i for i in got[q] if not 50 <= i < 65] == [i for i in taken if not 50 <= i < 65]


def test_measures(spark, table):
    path, x, label = table
    want = {}
    for q, near in lists(x, 10, 6).items():
        hit = [int(label[i] == label[q]) for _, i in near]
        total = int((label == label[q]).sum()) - 1
        for k in KS:
            ideal = sum(1 / np.log2(i + 1) for i in range(1, min(k, total) + 1))
            want[q, k] = (sum(hit[:k]) / k, sum(hit[:k]) / total, 1 / (hit.index(1) + 1) if 1 in hit else 0.0, sum(h / np.log2(i + 2) for i, h in enumerate(hit[:k])) / ideal)
    got = {(r["query_id"], r["k"]): (r["precision"], r["recall"], r["rr"], r["ndcg"]) for r in catalog.QUERIES["eval_per_query"](spark, path).collect()}
    assert sorted(got) == sorted(want) and all(np.allclose(got[a], want[a], atol=2e-6) for a in want)
    for r in catalog.QUERIES["eval_macro"](spark, path).collect():
        assert np.allclose([r["precision"], r["recall"], r["mrr"], r["ndcg"]], np.mean([v for (_, k), v in want.items() if k == r["k"]], axis=0), atol=2e-6)
