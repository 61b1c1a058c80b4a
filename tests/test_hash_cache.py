import pandas as pd

from clausespark import constants as K
from clausespark.functions import vectors as V


def test_word_cache_is_bounded():
    seen = V._seen_buckets()
    words = [f"w{i}" for i in range(V._CACHE_WORDS + 5)]
    V.hash_vectors.func(pd.Series([" ".join(words), "x" * 1000]))
    assert 0 < len(seen) <= V._CACHE_WORDS and "x" * 1000 not in seen


def test_counting_in_groups_changes_nothing(monkeypatch):
    texts = pd.Series(["bir ikki bir", None, "", "uch to'rt", "bir", "  "] * 5)
    whole = V.hash_vectors.func(texts)
    monkeypatch.setattr(V, "_COUNTED", 2)
    parts = V.hash_vectors.func(texts)
    for c in ("idx", "w"):
        assert [list(a) for a in whole[c]] == [list(a) for a in parts[c]]
    assert len(whole) == len(texts) and all((a < K.HASH_DIM).all() for a in whole["idx"])
