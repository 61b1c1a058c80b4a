"""Benchmark decontamination by a positional inverted index over the training text.

Test items are cut into windows of ten words. The index stores postings (term, document, position) of the
terms that are among a window's three rarest; which these are is known from counts over the whole training
text. The rarest term's list gives starts (position less the term's offset in the window); the starts are
intersected with the offset-adjusted lists of the second and third rarest terms. What is left is almost only
true occurrences; the words at the start are then compared with the whole window.

A term in a hot passage may hold a large share of all postings: its windows are joined through
``join_counted``, and every later join is on document and position. The chosen terms are broadcast only if
their number is at most ``BROADCAST_TERMS``. Occurrences of a document are collected per document only, where
they are bounded by its own length.

Defined cases: a null or wordless text, of a document or an item, has no words; items of fewer than ten words
are one window; repeated items and windows count once per item_id; a null item_id is no item but its windows
still hit; rows of equal doc_id and text are looked up once and each get the result; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import ascii_lower, join_counted, ordered_positions, own_columns, row_key, split_words
from clausespark.session import cut_lineage

#: The text is lower-cased first, so upper-case letters never occur.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: Separators of the text as it stands, for counting its words.
RAW_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WINDOW = 10
LISTS = 3
BROADCAST_TERMS = 1_000_000


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (w, terms, n) of the item texts, and which items have them (w, item_id)."""
    t = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    t = t.select("item_id", "words", F.explode(starts).alias("i")).select("item_id", F.slice("words", F.col("i"), size).alias("terms"))
    distinct = t.select(F.array_join("terms", " ").alias("phrase")).distinct()
    distinct = cut_lineage(ordered_positions(distinct, [F.col("phrase")], pos="w"))
    owners = t.select("item_id", F.array_join("terms", " ").alias("phrase")).distinct().join(distinct, "phrase").select("w", "item_id")
    terms = F.split("phrase", " ")
    return distinct.select("w", terms.alias("terms"), F.size(terms).alias("n")), cut_lineage(owners)


def tokens(docs: DataFrame) -> DataFrame:
    """(key, pos, term) of every word of ``docs`` (key, text), positions from 0."""
    t = docs.select("key", words_of(F.col("text")).alias("words"))
    return t.select("key", F.posexplode("words").alias("pos", "term"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, freq) over the whole text; counted per task before anything is shuffled."""
    return docs.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index (term, key, pos) for the given distinct terms."""
    terms = cut_lineage(terms.select("term"))
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    return cut_lineage(tokens(docs).join(terms, "term"))


def rarest_terms(win: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(w, terms, rare, freq): the ``lists`` rarest (term, off) of each window, rarest first; windows with an unknown term go."""
    probes = win.select("w", F.posexplode("terms").alias("off", "term"))
    known = cut_lineage(counts.join(probes.select("term").distinct(), "term"))
    entry = F.struct("freq", "off", "term")
    rare = probes.join(known, "term").groupBy("w").agg(F.count(F.lit(1)).alias("found"), F.sort_array(F.collect_list(entry)).alias("by"))
    rare = rare.join(win, "w").filter("found = n")
    return rare.select("w", "terms", F.slice("by", 1, lists).alias("rare"), F.element_at("by", 1)["freq"].alias("freq"))


def occurrences(docs: DataFrame, win: DataFrame) -> DataFrame:
    """(key, w, start, n): every place in ``docs`` (key, text) where a window's words stand one after another."""
    rare = cut_lineage(rarest_terms(win, term_counts(docs)))
    index = postings(docs, rare.select(F.explode("rare.term").alias("term")).distinct())
    by_term = rare.groupBy(F.element_at("rare", 1)["term"].alias("term")).agg(
        F.max("freq").alias("freq"), F.collect_list(F.struct("w", "terms", "rare")).alias("windows"))
    wanted = index.join(F.broadcast(by_term.select("term")), "term", "left_semi") if by_term.count() <= BROADCAST_TERMS else index
    t = join_counted(wanted, by_term, "term", "freq", ["key", "pos"]).filter("windows is not null")
    t = t.select("key", "pos", F.explode("windows").alias("x")).select("key", "x.w", "x.terms", "x.rare", (F.col("pos") - F.element_at("x.rare", 1)["off"]).alias("start"))
    t = cut_lineage(t.filter("start >= 0"))
    for k in range(2, LISTS + 1):
        at = F.get("rare", F.lit(k - 1))
        more = t.filter(F.size("rare") >= k).withColumns({"__t": at["term"], "__p": F.col("start") + at["off"]})
        listed = index.select("key", F.col("term").alias("__t"), F.col("pos").alias("__p"))
        more = more.join(listed, ["key", "__t", "__p"], "left_semi").drop("__t", "__p")
        t = t.filter(F.size("rare") < k).unionByName(more)
    t = t.select("key", F.struct("start", "w", "terms").alias("c")).distinct().groupBy("key").agg(F.collect_list("c").alias("places"))
    text = docs.select("key", "text").join(cut_lineage(t), "key").select("key", "places", words_of(F.col("text")).alias("words"))
    here = F.filter("places", lambda c: (c["start"] + F.size(c["terms"]) <= F.size("words")) & (F.slice(F.col("words"), c["start"] + 1, F.size(c["terms"])) == c["terms"]))
    t = text.select("key", F.explode(here).alias("c"))
    return t.select("key", "c.w", "c.start", F.size("c.terms").alias("n")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, n_hit, n_items, items_sha256) of the documents (doc_id, text) in which a window of an item occurs."""
    keyed = docs.select(row_key().alias("key"), "text")
    win, owners = windows(items, size)
    found = cut_lineage(occurrences(keyed, win))
    hits = found.select("key", "start", "n").distinct().select("key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
    hits = hits.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    pairs = cut_lineage(found.select("key", "w").distinct())
    lookup = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("docs")).join(owners.groupBy("w").agg(F.collect_set("item_id").alias("items")), "w")
    named = join_counted(pairs, lookup, "w", "docs", ["key"]).select("key", F.explode("items").alias("item_id")).distinct()
    named = named.groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    named = named.select("key", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return hits.join(named, "key", "left")


def mark_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    out = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kept = own_columns(docs, *out)
    found = cut_lineage(contamination(docs.select("doc_id", "text"), items, size)).withColumnRenamed("key", "__key")
    count = F.size(split_words(F.col("text"), RAW_SEPARATORS)).cast("long")
    t = docs.select(*kept, count.alias("n_words"), row_key().alias("__key")).join(found, "__key", "left")
    t = t.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items")})
    t = t.withColumns({"items_sha256": F.coalesce("items_sha256", F.sha2(F.lit(""), 256)), "contaminated": F.col("n_hit") > 0})
    return t.select(*kept, *out)


def near_matches(docs: DataFrame, phrases: DataFrame, reach: int) -> DataFrame:
    """(key, w, pos): proximity matches, where all words of a phrase stand at most ``reach`` words from its rarest one.

    ``docs`` is (key, text), ``phrases`` (w, terms, n) as ``windows`` returns. Positions are met through buckets
    of ``reach + 1`` places, so each list joins with at most three buckets around a place.
    """
    rare = cut_lineage(rarest_terms(phrases, term_counts(docs), lists=1))
    wide = reach + 1
    index = postings(docs, rare.select(F.explode("terms").alias("term")).distinct()).withColumn("b", F.floor(F.col("pos") / wide))
    anchors = rare.select("w", F.array_distinct("terms").alias("terms"), F.element_at("rare", 1)["term"].alias("term"))
    a = index.join(anchors, "term").select("key", "w", F.col("pos").alias("at"), F.size("terms").alias("n"), F.explode("terms").alias("term"))
    a = a.withColumn("b", F.explode(F.array(*[F.floor(F.col("at") / wide) + d for d in (-1, 0, 1)])))
    t = a.join(index, ["key", "term", "b"]).filter(F.abs(F.col("pos") - F.col("at")) <= reach)
    t = t.groupBy("key", "w", "at", "n").agg(F.count_distinct("term").alias("met")).filter("met = n")
    return t.select("key", "w", F.col("at").alias("pos"))


ORACLE = r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from item_words where len(w) > 0)),
doc_windows as (
  select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as phrase
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct n from item_windows) where len(w) >= n)),
found as (select d.doc_id, d.i, d.n, x.item_id from doc_windows d join item_windows x on d.n = x.n and d.phrase = x.phrase),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, sha256(string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar))) as items_sha256
  from (select distinct doc_id, item_id from found) group by doc_id)
select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hits on words.doc_id = hits.doc_id left join items on words.doc_id = items.doc_id
"""
