"""Domain views over the driver tables: every view is a pure projection of a Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import text as X
from clausespark.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where a scan has fewer splits than the session has slots.

    Text work is CPU-bound, so a table of a few small files would run on a few threads. A table
    with enough splits, as any large one has, is returned as it is and gets no shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose text columns are about to be processed."""
    return spread(table(spark, folder, name))


def code_of(n: Column) -> Column:
    """Document code derived from a document number."""
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(
        F.lit("SHNQ "), (1 + n % 9).cast("string"), F.lit("."), two(n % 100), F.lit("."), two(n % 13),
        F.lit("-"), (10 + n % 15).cast("string"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """section = language, category = source, code derived from the number, title = first line."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("section_code"),
        F.col("source").alias("category_code"),
        code_of(F.col("doc_id")).alias("code"),
        F.left(X.squeeze(F.split("text", "\n", 2)[0]), F.lit(80)).alias("title"),
    )


def clauses(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line of at least thirty cleaned characters.

    The running order comes from the array position after filtering, so no window or shuffle is
    needed and a document never has to be gathered again.
    """
    d = texts(spark, folder, "documents")
    lines = F.filter(F.transform(F.split("text", "\n"), X.clean_text), lambda t: F.length(t) >= K.MIN_TEXT_LEN)
    e = d.select("doc_id", "lang", F.posexplode(lines).alias("pos", "text"))
    order = (F.col("pos") + 1).cast("bigint")
    chapter = (F.floor(F.col("pos") / 10) + 1).cast("bigint")
    return e.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), order.cast("string")).alias("clause_id"),
        F.col("doc_id").alias("document_id"),
        code_of(F.col("doc_id")).alias("code"),
        order.alias("clause_order"),
        F.concat_ws(".", (1 + F.col("doc_id") % 9).cast("string"), order.cast("string")).alias("clause_number"),
        chapter.alias("chapter_order"),
        F.concat(chapter.cast("string"), F.lit("-bob "), F.col("lang")).alias("chapter_title"),
        F.col("text"),
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def norm_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Requirement sentences, one per part; every third states a maximum in percent."""
    p = texts(spark, folder, "part")
    size = F.col("p_size").cast("string")
    third = F.col("p_partkey") % 3 == 0
    return p.select(
        F.col("p_partkey").alias("qid"),
        F.when(third, F.concat(F.col("p_name"), F.lit(" ulushi ko'pi bilan "), size, F.lit(" foiz bo'lishi kerak.")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" kengligi kamida "), size, F.lit(" mm bo'lishi kerak.")))
        .alias("text"),
        F.col("p_size"),
        F.col("p_name"),
    )


def reference_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions with explicit references, one per part."""
    p = texts(spark, folder, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    return p.select(
        k.alias("qid"),
        F.when(
            k % 4 == 0,
            F.concat(F.lit("SHNQ 2.01.05-24 bo'yicha 3."), size, F.lit(" band va "), (F.col("p_size") % 9).cast("string"), F.lit("-jadval")),
        )
        .when(k % 4 == 1, F.concat(F.col("p_name"), F.lit(" uchun "), size, F.lit("-ilova va 2-bob qanday talab qo'yadi?")))
        .when(k % 4 == 2, F.concat(F.lit("QMQ 2.03."), F.lpad(size, 2, "0"), F.lit(" va KMK 1.02-97 farqi: "), size, F.lit("."), (k % 7).cast("string"), F.lit(" haqida")))
        .otherwise(F.concat(F.col("p_name"), F.lit(" kengligi necha mm bo'lishi kerak? rasm "), size))
        .alias("text"),
    )


def tables(spark: SparkSession, folder: str) -> DataFrame:
    """One table per brand; the document is the one numbered like the brand."""
    p = table(spark, folder, "part")
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    return (
        p.groupBy("p_brand")
        .agg(F.count(F.lit(1)).alias("row_count"), F.min("p_partkey").alias("first_part"))
        .select(
            F.col("p_brand").alias("table_id"),
            number.cast("bigint").alias("document_id"),
            code_of(number.cast("bigint")).alias("code"),
            number.alias("table_number"),
            F.concat(F.lit("Ro'yxat "), F.col("p_brand")).alias("title"),
            F.concat(number, F.lit("-bob materiallar")).alias("section_title"),
            number.cast("bigint").alias("table_order"),
            F.col("row_count"),
            F.col("first_part"),
        )
    )


def rows(spark: SparkSession, folder: str) -> DataFrame:
    """One table row per part."""
    p = table(spark, folder, "part")
    number = F.regexp_extract("p_brand", r"(\d+)", 1)
    return p.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_brand").alias("table_id"),
        F.col("p_partkey").alias("row_index"),
        number.cast("bigint").alias("document_id"),
        number.alias("table_number"),
        F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("texts"),
    )


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Four cells per row; the first row of each table carries the headers."""
    r = rows(spark, folder)
    e = r.select("row_id", "table_id", "row_index", F.posexplode("texts").alias("pos", "text"))
    return e.select(
        "row_id", "table_id", "row_index", (F.col("pos") + 1).cast("bigint").alias("col_index"), "text"
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ord"), "role", F.col("text").alias("content")
    )


def feedback_events(spark: SparkSession, folder: str) -> DataFrame:
    """Votes from the event log: purchase and signup are up, error is down."""
    e = table(spark, folder, "events")
    vote = F.when(F.col("event_type").isin("purchase", "signup"), "up").when(F.col("event_type") == "error", "down")
    return (
        e.withColumn("vote", vote)
        .where(F.col("vote").isNotNull())
        .select(
            "event_id", "ts", "user_id", "vote",
            F.concat(F.lit("Q"), F.get_json_object("props", "$.k"), F.lit("  savol")).alias("question"),
            F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("answer"),
            code_of(F.col("user_id") % 7).alias("code"),
            F.concat((1 + F.col("user_id") % 3).cast("string"), F.lit(".1")).alias("clause_number"),
            F.when(F.col("value") > 20, F.concat(F.lit("sabab "), (F.col("event_id") % 4).cast("string"))).alias("reason"),
        )
    )


def doc_processes(spark: SparkSession, folder: str) -> DataFrame:
    """Pipeline rows from orders; progress derives from the key."""
    o = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    k = F.col("o_orderkey")
    full = k % 5 == 0
    step = lambda m: F.when(full, F.lit(100)).otherwise((k * m) % 101).cast("bigint")
    return o.select(
        k.alias("document_id"), status.alias("status"), status.alias("stage"),
        step(1).alias("doc_html"), step(3).alias("chunking"), step(7).alias("row_embedding"),
        step(11).alias("img_embedding"), F.col("o_orderdate").alias("updated_at"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as double arrays, the label standing for the document."""
    e = table(spark, folder, "embeddings")
    return e.select(
        F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("bigint").alias("label")
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate lists from order lines: one list per order, clauses, rows and images mixed."""
    li = texts(spark, folder, "lineitem")
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.when(n % 4 == 0, "table_row").when(n % 4 == 3, "image").otherwise("clause")
    is_c, is_r, is_i = n % 4 % 3 != 0, n % 4 == 0, n % 4 == 3
    s = lambda c: c.cast("string")
    number = F.concat(s(1 + k % 3), F.lit("."), s(k % 4))
    return li.select(
        F.col("l_orderkey").alias("qid"),
        F.concat_ws("-", s(n), s(k), s(F.col("l_suppkey")), s(F.round(F.col("l_extendedprice") * 100).cast("bigint"))).alias("item_id"),
        kind.alias("kind"),
        F.when(is_c, F.concat(F.lit("C"), s(k % 500))).alias("clause_id"),
        F.when(is_r, F.concat(F.lit("T"), s(k % 6))).alias("table_id"),
        F.when(is_i, F.concat(F.lit("I"), s(k % 5))).alias("image_id"),
        F.when(is_c, F.concat(F.lit("Band "), number)).when(is_r, F.concat(F.lit("Jadval "), s(k % 6))).otherwise(F.concat(F.lit("Rasm "), s(k % 5))).alias("title"),
        F.concat(F.lit("Detal "), s(k), F.lit(" kengligi "), s(F.col("l_quantity").cast("int")), F.lit(" mm kerak")).alias("snippet"),
        code_of(F.col("l_suppkey") % 5).alias("code"),
        F.when(is_c, number).alias("clause_number"),
        F.when(is_r, s(k % 6)).alias("table_number"),
        F.when(is_r, n.cast("bigint")).alias("row_index"),
        F.when(is_i, s(k % 5)).alias("appendix_number"),
        F.concat(F.col("l_returnflag"), F.lit("-bob")).alias("chapter"),
        F.round((F.col("l_extendedprice") % 50) / 100, 6).alias("score"),
        F.round(F.col("l_discount") * 3, 6).alias("semantic"),
        F.round(F.col("l_tax") * 5, 6).alias("keyword"),
        F.round((k % 7) / 10, 6).alias("numeric"),
    )


def item_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The question behind each order's list."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(s(k % 6 + 3), F.lit("-jadval bo'yicha talab")))
        .when(k % 6 == 1, "rasm chizma kerak")
        .when(k % 6 == 2, F.concat(s(1 + k % 3), F.lit("."), s(k % 4), F.lit(" band nima deydi")))
        .when(k % 6 == 3, "detal kengligi kamida necha mm")
        .when(k % 6 == 4, F.concat(F.lit("Detal haqida "), s(k), F.lit(" umumiy tushuncha bering")))
        .otherwise("salom python haqida")
    )
    return texts(spark, folder, "orders").select(k.alias("qid"), text.alias("question"))
