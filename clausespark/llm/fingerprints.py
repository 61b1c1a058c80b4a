"""Document fingerprints: SimHash of weighted terms, searched through permuted block tables.

A term is two neighbouring words (the whole text if it has one word). Each term votes with its weight for or
against each of 128 bits, by the bits of two 64-bit hashes; a bit is set if the votes for it exceed those
against. The weight grows with the length of the term, as long terms are rare ones. Likeness of two
fingerprints is the cosine that their differing bits stand for, at least 0: cos(pi * d / 128).

To find all fingerprints within a radius r, the 128 bits are cut into blocks of 32; with r <= 3 one of the four
blocks of two such fingerprints is equal. Table k holds every fingerprint with block k in front; a query joins
each table on the leading block, the whole distance is then counted, and a pair is taken from the first table
that offers it. All of this is joins and aggregates of the DataFrame API.

Defined cases: a null text counts as empty; a text without words has fingerprint 0, whose likeness to another
such fingerprint is 1; rows with equal doc_id and text are one document and give equal result rows; rows that
share only their doc_id are ordered by a hash of the text; a null doc_id comes first; a single document is its
own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import ascii_lower, ordered_positions, row_key, split_words
from clausespark.llm.votes import distance, hex16, tally
from clausespark.session import cut_lineage

SPACES = r"\x20\x09-\x0D"
RADIUS = 3
BITS = 128
QUERY_STEP = 100


def weighted_terms(words: Column) -> Column:
    """Array of (h0, h1, weight) of the neighbouring pairs of words."""
    def entry(term: Column) -> Column:
        weight = F.least(F.lit(8), 1 + F.floor(F.length(term) / 4)).cast("bigint")
        return F.struct(F.xxhash64(term).alias("h0"), F.xxhash64(term, F.lit(1)).alias("h1"), weight.alias("weight"))

    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    terms = F.when(n > 1, pairs).otherwise(words)
    return F.transform(terms, entry)


def simhash(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, fp0, fp1, copies) for the texts; rows with an equal key must have equal texts."""
    t = texts.select(*key, split_words(ascii_lower(F.col(text)), SPACES).alias("__w"))
    t = t.select(*key, F.posexplode_outer(weighted_terms(F.col("__w"))).alias("__pos", "__t"))
    t = t.select(*key, "__pos", F.col("__t.h0").alias("__h0"), F.col("__t.h1").alias("__h1"), F.col("__t.weight").alias("__weight"))
    return tally(t, key, words=2, weight="__weight")


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    d = distance(a[0], b[0]) + distance(a[1], b[1])
    return F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(d * F.lit(math.pi / BITS))))


def hex32(fp0: Column, fp1: Column) -> Column:
    return F.concat(hex16(fp0), hex16(fp1))


def _blocks(fp0: Column, fp1: Column) -> list[Column]:
    return [f(x) for x in (fp0, fp1) for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)))]


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (q0, q1, fp0, fp1, distance, other columns of ``fps``) within ``radius`` (3 at most) of distinct query fingerprints."""
    def tables(df: DataFrame, a: str, b: str, block: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in enumerate(_blocks(F.col(a), F.col(b)))])
        return df.withColumn("__e", F.explode(entries)).withColumns({f"{block}k": F.col("__e.k"), f"{block}v": F.col("__e.v")}).drop("__e")

    q = tables(queries.select(F.col("fp0").alias("q0"), F.col("fp1").alias("q1")).distinct(), "q0", "q1", "__q")
    t = tables(fps, "fp0", "fp1", "__t")
    d = distance(F.col("q0"), F.col("fp0")) + distance(F.col("q1"), F.col("fp1"))
    same = [x == y for x, y in zip(_blocks(F.col("q0"), F.col("q1")), _blocks(F.col("fp0"), F.col("fp1")))]
    first = F.lit(len(same))
    for k in reversed(range(len(same))):
        first = F.when(same[k], F.lit(k)).otherwise(first)
    on = (F.col("__qk") == F.col("__tk")) & (F.col("__qv") == F.col("__tv")) & (d <= radius) & (first == F.col("__qk"))
    return q.join(t, on).withColumn("distance", d).drop("__qk", "__qv", "__tk", "__tv")


def with_key(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text) with a key that equal pairs of doc_id and text share."""
    return docs.select(row_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def next_documents(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_chars, next_key, before_key, wanted): neighbours in ascending doc_id, in a ring.

    ``wanted`` is how many code points the document before takes over, a quarter of its own.
    """
    ids = docs.select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars")).distinct()
    ids = cut_lineage(ordered_positions(ids, [F.col("doc_id").asc_nulls_first(), F.col("key").asc()]))
    total = F.lit(max(1, ids.count()))
    after = ids.select(F.pmod(F.col("pos") - 1, total).alias("pos"), F.col("key").alias("next_key"))
    before = ids.select(F.pmod(F.col("pos") + 1, total).alias("pos"), F.col("key").alias("before_key"), F.floor(F.col("n_chars") / 4).cast("int").alias("wanted"))
    return ids.join(after, "pos").join(before, "pos").drop("pos")


def edited_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, edited): the last quarter of each text replaced by as much of the start of the next one.

    Only the texts and their wanted starts are shuffled, both by the key of the document they end up in.
    """
    t = docs.select("key", "text").join(places.select("key", "before_key", "wanted", "n_chars"), "key")
    heads = t.select(F.col("before_key").alias("key"), F.substring("text", F.lit(1), F.col("wanted")).alias("head")).dropDuplicates(["key"])
    own = t.drop("before_key", "wanted").join(heads, "key")
    left = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    return own.select("key", F.concat(F.substring("text", F.lit(1), left), "head").alias("edited"))


def compare_with_edited(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and how like the next document's it is.

    ``n_near`` is, for the queries (doc_ids divisible by 100), the number of other rows within the radius, else null.
    """
    docs = with_key(docs)
    places = cut_lineage(next_documents(docs))
    own = cut_lineage(simhash(docs, ["key"], "text"))
    edited = edited_texts(docs, places).withColumn("edited_sha256", F.sha2("edited", 256))
    edited = simhash(edited, ["key", "edited_sha256"], "edited").select("key", "edited_sha256", F.col("fp0").alias("e0"), F.col("fp1").alias("e1"))
    following = own.select(F.col("key").alias("next_key"), F.col("fp0").alias("n0"), F.col("fp1").alias("n1"))

    rows = places.select("key", "doc_id", "n_chars", "next_key").join(own, "key").join(edited, "key").join(following, "next_key")
    fps = own.groupBy("fp0", "fp1").agg(F.sum("copies").alias("rows"))
    asked = places.filter(F.col("doc_id") % QUERY_STEP == 0).select("key").join(own, "key").select("key", "fp0", "fp1")
    near = within_radius(asked, fps, radius).groupBy("q0", "q1").agg((F.sum("rows") - 1).alias("n_near"))
    near = asked.join(near, (F.col("fp0") == F.col("q0")) & (F.col("fp1") == F.col("q1"))).select("key", "n_near")
    rows = rows.join(near, "key", "left")
    mine = (F.col("fp0"), F.col("fp1"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", hex32(*mine).alias("fingerprint"), hex32(F.col("e0"), F.col("e1")).alias("edited_fingerprint"),
        likeness(mine, (F.col("e0"), F.col("e1"))).alias("near_edited"), likeness(mine, (F.col("n0"), F.col("n1"))).alias("near_next"), "n_near",
    )
