"""Chat formatting by quotation linking: quoted passages are taken out of messages and linked to what they quote.

Lines that start with > are quoted, one level per sign; neighbouring lines of one level are a passage. What is
left, without the line that announces a quote, is the message's own text. Passages and own texts are normalised
(case and white space) and hashed, whole and line by line. A passage is linked by its whole hash or else by its
first line that is found: to the first message of the same conversation before it that says so, whatever its
length, else, if the quoted words are at least ``FAR_WORDS``, to the first message before it in any conversation.
Words are runs between white space; in scripts written without spaces every two letters count as one. Lookups hold one
row per hash, the first message, so no pairs of messages with a common line are ever made.

A message replies to what its first linked level-1 passage quotes, else to the message before it in its
conversation. Conversations that replies connect form a thread, named by its smallest conv_id. In a thread,
messages are ordered by conversation and turn, which puts every one behind the message it replies to.

Defined cases: a null text is empty; a null conv_id is a conversation of its own, before the others; repeated
(conv_id, turn) rows are messages of their own and tie; a null turn comes first; a message that only quotes has
an empty own text; an empty table gives an empty result; input columns other than conv_id, turn, role and text
are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import join_counted, ordered_positions
from clausespark.llm.gray_index import components
from clausespark.session import cut_lineage, ship_package

PREFIX = re.compile(r"[ \t]*((?:>[ \t]?)+)")
ANNOUNCED = re.compile(r"\b(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)
FAR_WORDS = 6
#: Thai, Lao, Myanmar, Khmer, kana and Han.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNIT = "struct<passage: int, level: int, priority: int, hash: bigint, words: int>"


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """Own text and quoted passages (level, text) of a message."""
    own, passages = [], []
    last = 0
    for line in text.split("\n"):
        m = PREFIX.match(line)
        level = m[1].count(">") if m else 0
        body = line[m.end():] if m else line
        if level == 0:
            own.append(body)
        elif level == last:
            passages[-1][1].append(body)
        else:
            if last == 0 and own and ANNOUNCED.search(own[-1]):
                own.pop()
            passages.append((level, [body]))
        last = level
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in passages]


def length(text: str) -> int:
    """Words of a normalised text."""
    return max(len(text.split()), len(SPACELESS.findall(text)) // 2)


def units(text: str) -> list[tuple[int, int, int]]:
    """(priority, hash, words) of a text: the whole first, then its lines."""
    whole = normalise(text)
    out = [(0, digest(whole), length(whole))] if whole else []
    lines = [normalise(x) for x in text.split("\n")]
    lines = [x for x in lines if x and x != whole]
    return out + [(i + 1, digest(x), length(x)) for i, x in enumerate(lines)]


def parsed(messages: DataFrame) -> DataFrame:
    """(id, conv_id, turn, role, own, n_quotes, max_level, said, quoted), one row per message, numbered by conversation and turn."""
    ship_package(messages.sparkSession)

    @F.pandas_udf(f"struct<own: string, n_quotes: int, max_level: int, said: array<{UNIT}>, quoted: array<{UNIT}>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ("passage", "level", "priority", "hash", "words")
        for column in batches:
            out = []
            for text in column:
                own, passages = parse(text or "")
                said = [dict(zip(names, (0, 0, *u))) for u in units(own)]
                quoted = [dict(zip(names, (i, level, *u))) for i, (level, p) in enumerate(passages) for u in units(p)]
                out.append((own, len(passages), max((level for level, _ in passages), default=0), said, quoted))
            yield pd.DataFrame(out, columns=["own", "n_quotes", "max_level", "said", "quoted"])

    t = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    t = ordered_positions(t, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text")], pos="id")
    return cut_lineage(t.select("id", "conv_id", "turn", "role", read("text").alias("p")).select("id", "conv_id", "turn", "role", "p.*"))


def _lookup(quoted: DataFrame, said: DataFrame, scope: Column, least_words: int) -> DataFrame:
    """(id, passage, level, priority, to): quoted units that an earlier message of the scope says, and the first that does."""
    key = F.concat_ws(":", scope, F.hex("hash"))
    first = said.withColumn("key", key).groupBy("key").agg(F.min("id").alias("to"))
    asked = quoted.where(F.col("words") >= least_words).withColumn("key", key)
    first = first.join(asked.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    t = join_counted(asked.select("id", "passage", "level", "priority", "key"), first, "key", "n", ["id", "passage"])
    return t.where(F.col("to") < F.col("id")).drop("key", "n")


def quote_links(messages: DataFrame) -> DataFrame:
    """(id, passage, level, to): every quoted passage that is found, with the message it quotes."""
    spread = lambda c: messages.select("id", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv"), F.explode(c).alias("u")).select("id", "conv", "u.*")
    said, quoted = spread("said"), spread("quoted")
    near = _lookup(quoted, said, F.col("conv"), 1).withColumn("far", F.lit(0))
    far = _lookup(quoted, said, F.lit("all"), FAR_WORDS).withColumn("far", F.lit(1))
    best = F.min(F.struct("far", "priority", "to"))
    return near.unionByName(far).groupBy("id", "passage", "level").agg(best.alias("b")).select("id", "passage", "level", "b.to")


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message in reply order: thread, position, conv_id, turn, role, text (own), quotes and the message replied to."""
    m = parsed(messages)
    links = cut_lineage(quote_links(m))
    direct = links.where("level = 1").groupBy("id").agg(F.min_by("to", "passage").alias("quoted_id"))
    counted = links.groupBy("id").agg(F.count(F.lit(1)).alias("n_linked"))
    t = m.drop("said", "quoted").join(counted, "id", "left").join(direct, "id", "left")
    # the message before, if it is of the same conversation
    before = m.select((F.col("id") + 1).alias("id"), F.col("conv_id").alias("before_conv"), F.col("id").alias("before_id"))
    t = t.join(before, "id", "left")
    same = F.col("before_id").isNotNull() & F.col("conv_id").eqNullSafe(F.col("before_conv"))
    t = t.withColumn("reply_id", F.coalesce("quoted_id", F.when(same, F.col("before_id"))))
    target = m.select(F.col("id").alias("reply_id"), F.col("conv_id").alias("reply_conv"), F.col("turn").alias("reply_turn"))
    counts = t.where("reply_id IS NOT NULL").groupBy("reply_id").agg(F.count(F.lit(1)).alias("n"))
    t = cut_lineage(join_counted(t, target.join(counts, "reply_id"), "reply_id", "n", ["id"]).drop("n"))
    across = t.where("conv_id <> reply_conv").select(F.col("conv_id").alias("a"), F.col("reply_conv").alias("b")).distinct()
    roots = components(across).withColumnRenamed("node", "conv_id")
    sizes = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    t = join_counted(t, roots.join(sizes, "conv_id"), "conv_id", "n", ["id"]).drop("n").withColumn("thread", F.coalesce("root", "conv_id"))
    t = ordered_positions(t, [F.col("thread").asc_nulls_first(), F.col("id")], pos="place")
    begins = t.groupBy("thread").agg(F.min("place").alias("begin"), F.count(F.lit(1)).alias("n"))
    null = F.lit("null")
    name = lambda: F.coalesce(F.col("thread").cast("string"), null)
    t = join_counted(t.withColumn("key", name()), begins.select(name().alias("key"), "begin", "n"), "key", "n", ["id"])
    return t.select(
        "thread", (F.col("place") - F.col("begin")).alias("position"), "conv_id", "turn", "role", F.col("own").alias("text"), "n_quotes", "max_level",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_conv", "reply_turn", F.col("quoted_id").isNotNull().alias("by_quote"),
    )


def formatted(messages: DataFrame) -> DataFrame:
    """``conversations`` with each message as a line of chat markup (``formatted``)."""
    return conversations(messages).withColumn("formatted", F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text", F.lit("\n<|end|>")))
