"""Spans (kind, start, end) in code points: pattern matches, tagged ones, and both of them as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import own_columns
from clausespark.llm.crf import Crf
from clausespark.session import ship_package

Span = tuple[str, int, int]
SPANS = "array<struct<kind: string, start: int, end: int>>"
#: Code points that are tagged together, the length of a piece of a longer text, and what pieces see beyond their ends.
TOGETHER, PIECE, OVERLAP = 1 << 20, 1 << 22, 1 << 10


def tag_all(crf: Crf, texts: list[str], classify: Callable[[str], int]) -> list[list[Span]]:
    """Tagged spans of whole texts in bounded memory: many short ones together, a very long one piece by piece."""
    out: list[list[Span]] = [[] for _ in texts]
    jobs, filled = [], 0

    def run() -> None:
        nonlocal jobs, filled
        if jobs:
            for (i, shift, low, high, _, _), spans in zip(jobs, crf.tag([j[4] for j in jobs], np.array([j[5] for j in jobs]))):
                out[i] += [(k, a + shift, b + shift) for k, a, b in spans if low <= a + shift < high]
        jobs, filled = [], 0

    for i, text in enumerate(texts):
        kind = classify(text)
        for low in range(0, len(text), PIECE):
            begin, high = max(0, low - OVERLAP), min(len(text), low + PIECE)
            piece = text[begin:high + OVERLAP]
            jobs.append((i, begin, low, high, piece, kind))
            filled += len(piece)
            if filled >= TOGETHER:
                run()
    run()
    return out


def beside(base: list[Span], tagged: list[Span], text: str, accept: Callable[[str, str], bool]) -> list[Span]:
    """The tagged spans that pass their check and touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    kept = []
    for k, a, b in tagged:
        i = np.searchsorted(starts, b) - 1
        if (i < 0 or reach[i] <= a) and accept(k, text[a:b]):
            kept.append((k, a, b))
    return kept


def add_spans(docs: DataFrame, find: Callable[[str], list[Span]], crf: Crf, classify: Callable[[str], int], accept: Callable[[str, str], bool]) -> DataFrame:
    """``docs`` with ``base_spans`` (pattern matches) and ``tagged_spans`` (found by the field alone), each ordered."""
    kept = own_columns(docs, "base_spans", "tagged_spans")
    ship_package(docs.sparkSession)

    @F.pandas_udf(f"struct<base: {SPANS}, tagged: {SPANS}>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        entry = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]
        for column in batches:
            texts = [x or "" for x in column]
            base = [find(x) for x in texts]
            tagged = [beside(b, t, x, accept) for b, t, x in zip(base, tag_all(crf, texts, classify), texts)]
            yield pd.DataFrame({"base": [entry(x) for x in base], "tagged": [entry(x) for x in tagged]})

    t = docs.select(*kept, scan(F.col("text")).alias("__s"))
    return t.select(*kept, F.col("__s.base").alias("base_spans"), F.col("__s.tagged").alias("tagged_spans"))


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span by start, then by the kind's place in ``kinds``, comma-joined."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("at"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, base_kinds: list[str], tagged_kinds: list[str]) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and all spans of the result of ``add_spans``."""
    base = F.sha2(joined(F.col("base_spans"), base_kinds), 256)
    spans = joined(F.concat("base_spans", "tagged_spans"), base_kinds + tagged_kinds)
    return docs.select("doc_id", *[count_kind("base_spans", k).alias(f"n_{k}") for k in base_kinds], base.alias("base_sha256"), spans.alias("spans"))
