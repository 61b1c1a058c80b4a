import math

import numpy as np

from clausespark.llm import cap_filters

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, Tile int"


def plain(rows):
    """Links by comparing all pairs of rows of a label."""
    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.asarray(v, dtype=np.float32).astype(float)
        a = a / np.abs(a).max()
        return a / np.linalg.norm(a)

    units, near = [unit(r[1]) for r in rows], [set() for _ in rows]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= 0.98:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, work = {i}, [i]
        while work:
            for j in near[work.pop()] - seen:
                seen.add(j)
                work.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], len(near[i]), least, r[0] == least))
    return sorted(out, key=repr)


def rows():
    rng = np.random.default_rng(5)
    unit = lambda n, dim=64: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.standard_normal((n, dim)))
    out = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(unit(300))]
    for k, noise in enumerate((0.05, 0.1, 0.13)):  # near copies around one vector each, some of them in chains
        centre = unit(1)
        out += [(1000 + 100 * k + i, v.tolist(), 1) for i, v in enumerate(centre + noise * unit(90))]
    same = unit(1)[0]
    out += [(2000 + i, (same * (1 if i < 50 else 4)).tolist(), 2) for i in range(80)] + [(2500, same.tolist(), 0), (2501, same.tolist(), None)]
    out += [(3000, None, 1), (3001, [0.0] * 64, 1), (3002, [None] + [1.0] * 63, 1), (3003, [float("nan")] * 64, 1), (3004, [float("inf")] * 64, 1), (3005, [], 1)]
    out += [(None, same.tolist(), 2), (7, same.tolist(), 2), (7, same.tolist(), 2), (None, unit(1)[0].tolist(), 2), (4000, [1.0, 0.0], 2), (4001, [0.99, 0.01], 2), (4002, [3e38, 3e36], 2), (4003, [-0.0, 1.0], 2), (4004, [0.0, 2.0], 2)]
    return [(*r, "x", 1) for r in out]


def found(df):
    return sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"] if r["vec_id"] is not None else r["vec_id"] == r["component_id"]) for r in df.collect()], key=repr)


def test_against_all_pairs(spark):
    data = rows()
    out = cap_filters.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(5), tile=32)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = found(out), plain(data)
    assert len(got) == len(want)
    links = sum(r[1] for r in want)
    assert sum(r[1] for r in got) >= 0.995 * links and all(g[1] <= w[1] for g, w in zip(got, want) if g[0] is not None and g[0] != 7)
    assert sum(g == w for g, w in zip(got, want)) >= 0.97 * len(want)


def test_empty(spark):
    assert cap_filters.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = cap_filters.units(rng.standard_normal((1000, 64)).tolist())
    z = rng.standard_normal((1000, 64))
    z = cap_filters.units((z - (z * x).sum(axis=1, keepdims=True) * x).tolist())
    codes = [cap_filters.Code(64, k) for k in range(cap_filters.CODES)]
    one, two = cap_filters.filters(x, codes), cap_filters.filters(0.98 * x + math.sqrt(1 - 0.98**2) * z, codes)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(one, two)]) >= 0.99


def test_decoding_finds_all_filters_above():
    rng = np.random.default_rng(3)
    x = cap_filters.units(rng.standard_normal((50, 30)).tolist())
    code = cap_filters.Code(30, parts=2, words=8)
    y = code.rotate(x).reshape(50, 2, -1)
    assert np.allclose(np.linalg.norm(code.rotate(x), axis=1), 1)
    all_ = (np.einsum("nd,wd->nw", y[:, 0], code.book[0])[:, :, None] + np.einsum("nd,wd->nw", y[:, 1], code.book[1])[:, None]).reshape(50, -1)
    least = np.minimum(1.0 / np.sqrt(code.wide), all_.max(axis=1) * cap_filters.NEARLY)
    row, number = code.decode(x, 1.0)
    assert set(zip(row.tolist(), number.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(all_ >= least[:, None] - 1e-12))))
