import itertools

import numpy as np
import pytest

from clausespark.llm.crf import Crf, tokenize

ROWS = [("call 555 now", [("num", 5, 8)]), ("nothing here", []), ("a 12 b 999", [("num", 7, 10)]), ("x", [])]


def small(seed=0, kinds=("num",)):
    crf = Crf(list(kinds), ["call", "b"], classes=2)
    rng = np.random.default_rng(seed)
    for k in crf.w:
        crf.w[k] = rng.standard_normal(crf.w[k].shape)
    return crf


def test_tokens_cover_all_but_white_space():
    texts = ["Ab1 é-x\n\t(42)", "", "  ", "@@", "日本 x" + "y" * 40]
    t = tokenize(texts)
    for i, text in enumerate(texts):
        mine = [text[s - t.offset[i]:e - t.offset[i]] for s, e, j in zip(t.start, t.end, t.text) if j == i]
        assert "".join(mine) == "".join(text.split())
    assert [texts[0][s:e] for s, e in zip(t.start[:6], t.end[:6])] == ["Ab1", "é", "-", "x", "(", "42"]


def test_gradients_equal_differences():
    crf = small()
    t = tokenize([r[0] for r in ROWS])
    found = crf.features(t, np.array([0, 1, 0, 1]))
    label = np.random.default_rng(1).integers(3, size=len(t.start))
    first = np.searchsorted(t.text, np.arange(4))
    size = np.diff(np.r_[first, len(t.text)])
    place, real = np.minimum(first[:, None] + np.arange(size.max()), len(label) - 1), np.arange(size.max()) < size[:, None]
    _, grads = crf.loss_and_gradients(found, label, place, real)
    for k, rows in {**found, "move": np.arange(3)}.items():
        for row in set(rows.tolist()[:4]):
            old = crf.w[k][row, 1]
            crf.w[k][row, 1] = old + 1e-6
            up = crf.loss_and_gradients(found, label, place, real)[0]
            crf.w[k][row, 1] = old - 1e-6
            down = crf.loss_and_gradients(found, label, place, real)[0]
            crf.w[k][row, 1] = old
            assert grads[k][row, 1] == pytest.approx((up - down) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("lead", [0, 4])
def test_decoding_equals_exhaustive_search(seed, lead):
    crf = small(seed, ("a", "b"))
    rng = np.random.default_rng(seed)
    e = rng.standard_normal((7, 5)) * 2
    e[rng.integers(7, size=3), 0] += lead * 3
    move = crf.w["move"]

    def score(y):
        y = (0, *y, 0)  # the texts end in O
        return sum(e[t, y[t + 1]] for t in range(7)) + sum(move[a, b] for a, b in zip(y, y[1:]))

    best = max(itertools.product(range(5), repeat=7), key=score)
    padded = np.vstack([np.zeros((1, 5)), e, np.zeros((1, 5))])
    got = crf.decode(padded, np.array([True] + [False] * 7 + [True]))
    assert tuple(got[1:-1]) == best


def test_learns_its_table_and_gives_code_points():
    rows = [(f"é {'call' if i % 2 else 'pay'} {i * 37 % 1000} today", [("num", 7 if i % 2 else 6, (7 if i % 2 else 6) + len(str(i * 37 % 1000)))] if i % 2 else []) for i in range(60)]
    crf = Crf(["num"], ["call", "pay"]).fit(rows, np.zeros(60, dtype=int), epochs=15, batch=20)
    assert crf.tag(["é call 123 today", "é pay 123 today", ""], np.zeros(3, dtype=int)) == [[("num", 7, 10)], [], []]
