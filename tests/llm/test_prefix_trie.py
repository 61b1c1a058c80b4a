import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from clausespark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, idx int, Rep string"


def plain(rows):
    """The nodes of the trie by building every sequence in full."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        full[c] = tuple(own.get(base, [])[:h] + mine[h:])
    members = {}
    for c, t in full.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = {}
    for key, who in members.items():
        below = [k for k in members if k[:len(key)] == key]
        ends = sorted(c for c in who if len(full[c]) == len(key))
        out[min(who), len(key)] = (
            min(members[key[:-1]]) if key else None,
            len(who),
            sum(1 for k in below if len(k) == len(key) + 1),
            sum(1 for k in below if not any(len(m) == len(k) + 1 and m[:-1] == k for m in below)),
            sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def rows():
    rng = random.Random(11)
    out = []
    for c in [*range(0, 260), 900, 1007, 1100, 5003]:
        for turn in rng.sample(range(12), rng.randrange(0, 9)):
            out.append((c, turn, rng.choice("ua"), rng.choice(["hello", "yes", "no ünï", "\U0001F600"])))
    out += [(300, i, "u", f"long {i % 7}") for i in range(400)] + [(301, i, "u", f"long {i % 7}") for i in range(400)]
    out += [(400 + i, k, "u", "copy") for i in range(60) for k in range(3)]
    out += [(None, 1, "u", "nobody"), (7, None, "u", "first"), (7, None, None, None), (8, 3, "u", ""), (8, 3, "u", ""), (-5, 1, "u", "below zero"), (600, 1, None, "x" * 50000)]
    return [(*r, 1, "z") for r in out]


def found(df):
    return {(r["conv_id"], r["depth"]): tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()}


@pytest.mark.parametrize("small", [120, prefix_trie.SMALL])
def test_against_all_sequences(spark, monkeypatch, small):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    data = rows()
    out = prefix_trie.prefix_trie(spark.createDataFrame(data, SCHEMA).repartition(5), small)
    assert out.count() == len(plain(data))
    assert found(out) == plain(data)


def test_empty(spark):
    out = prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[:3] == ["conv_id", "depth", "parent_conv_id"]


def test_decompose_any_forest():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        for reach in (1, 3, n):  # chains, narrow and random trees
            parent = np.array([-1 if i == 0 or rng.random() < 0.02 else rng.integers(max(0, i - reach), i) for i in range(n)])
            order = rng.permutation(n)
            at = np.argsort(order)
            parent = np.where(parent[order] < 0, -1, at[parent[order]])
            values = rng.integers(-5, 5, (n, 2))
            size, want = np.ones(n, dtype=np.int64), values.copy()
            for i in sorted(range(n), key=lambda i: -order[i]):
                if parent[i] >= 0:
                    size[parent[i]] += size[i]
                    want[parent[i]] += want[i]
            assert (prefix_trie.decompose(parent, size, values) == want).all()
