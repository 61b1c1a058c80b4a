import math

import numpy as np
import pytest

from clausespark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, Window int"


def plain(rows):
    kept = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        if sum((abs(256 * float(np.float32(x))) + 1) ** 2 for x in v) > 2**55:
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept[vec_id] = min(kept.get(vec_id, (label, q)), (label, q))
    out = set()
    for a, (own, q) in kept.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), b, label) for b, (label, w) in kept.items() if b != a)
        for s, p, _ in [x for x in scored if x[2] == own][:5]:
            window = [x for x in scored if x[2] != own and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out |= {(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(window)}
    return out


def rows():
    rng = np.random.default_rng(12)
    v = rng.standard_normal((700, 12))
    v[300:500] = v[:200] + 0.4 * rng.standard_normal((200, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = [(i, x.tolist(), int(rng.integers(0, 4))) for i, x in enumerate(v)]
    out += [(1000 + i, v[5].tolist(), i % 5) for i in range(120)]  # ties
    out += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 12, 1), (2150, v[0].tolist(), None), (None, v[0].tolist(), 1), (2200, [float("inf")] * 12, 2)]
    out += [(2250, [], 1), (2300, [0.0] * 12, 2), (2350, [0.5, 0.5], 3), (2400, [1e30] * 12, 1), (2450, [1e5] * 12, 1), (2451, [9e4] * 12, 1), (2452, [6e4] * 12, 2), (2500, [0.1] * 12, 9)]
    out += [(50, v[50].tolist(), out[50][2]), (51, v[52].tolist(), 0), (-100, v[7].tolist(), 1), (-93, v[8].tolist(), -4)]
    return [(*r, "x", 1) for r in out]


@pytest.mark.parametrize("block, group", [(64, 8), (hard_negatives.BLOCK, hard_negatives.GROUP)])
def test_against_all_scores(spark, block, group):
    data = rows()
    out = hard_negatives.mine(spark.createDataFrame(data, SCHEMA).repartition(4), block=block, group=group)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(data)


def test_empty(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reads_no_further_than_the_threshold():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.random((4000, 3)))
    x[:20] += 400
    lists = hard_negatives.Lists(x)
    places, scores = lists.search(np.array([3.0, 2.0, -1.0]), np.ones(4000, dtype=bool), np.full(1, -np.inf), np.full(1, np.inf), 5)
    assert len(places) < 400
    assert sorted(scores)[-5:] == sorted(x @ np.array([3.0, 2.0, -1.0]))[-5:]
