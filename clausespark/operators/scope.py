"""Documents that a question may be answered from, as tables of scopes.

Many questions share a scope (a category, a section, the documents a user picked), so a scope is stored once
and questions name it. Search tests membership before anything is ranked: postings are joined to the members
of the scopes that ask for their term, and block scoring multiplies only the rows a scope allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.functions import refs as R
from clausespark.session import cut_lineage

#: Scope key of questions that may use every document.
EVERYTHING = ""


@dataclass(frozen=True)
class Scopes:
    """assigned: (qid, scope), at most one row per question. members: (scope, code).

    A question without a row, or with a null scope, searches everything. A scope without members finds
    nothing. Codes compare without case and white space; null codes are no members; repeated rows count once.
    """

    assigned: DataFrame
    members: DataFrame

    @classmethod
    def of_pairs(cls, pairs: DataFrame) -> Scopes:
        """Scopes of (qid, code) rows; questions with the same set of codes share one.

        A set is known by its size and two order-free sums of hashes, so no list of codes is gathered.
        """
        p = pairs.select("qid", R.code_key("code").alias("code")).where("code <> ''").distinct()
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "code").cast("decimal(38,0)")).cast("string")
        assigned = p.groupBy("qid").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), total(1), total(2)).alias("scope"))
        one = assigned.groupBy("scope").agg(F.min("qid").alias("qid"))
        return cls(assigned, p.join(one, "qid").select("scope", "code"))

    def keyed(self, questions: DataFrame, qid: Column | str = "qid") -> DataFrame:
        """The questions with a column ``within``: their scope, or ``EVERYTHING``."""
        a = self.assigned.select(F.col("qid").alias("_asked"), _key("scope").alias("within"))
        q = questions.withColumn("_asked", F.col(qid) if isinstance(qid, str) else qid).join(a, "_asked", "left")
        return q.drop("_asked").withColumn("within", F.coalesce("within", F.lit(EVERYTHING)))

    def rows(self) -> DataFrame:
        """Distinct (within, code_key) of all members."""
        m = self.members.select(_key("scope").alias("within"), R.code_key("code").alias("code_key"))
        return m.where("within IS NOT NULL AND code_key <> ''").distinct()

    def rekeyed(self, questions: DataFrame, original: Column) -> Scopes:
        """The same scopes for questions with new keys; ``original`` is the key they had."""
        a = self.assigned.select(F.col("qid").alias("_asked"), "scope")
        q = questions.select("qid", original.alias("_asked")).distinct()
        return Scopes(q.join(a, "_asked").select("qid", "scope"), self.members)


def _key(scope: str) -> Column:
    return F.concat(F.lit("="), F.col(scope).cast("string"))


def homes(items: DataFrame, key: str) -> DataFrame:
    """(key, code_key) of items that carry a document code."""
    return items.select(key, R.code_key("code").alias("code_key"))


def allow(items: DataFrame, scopes: Scopes) -> DataFrame:
    """The items with ``scopes``: the keys of all scopes that hold their document, null if none does.

    The list of a document holds each distinct scope at most once, however many questions name it.
    """
    asked = scopes.assigned.select(_key("scope").alias("within")).distinct()
    rows = scopes.rows().join(asked, "within", "left_semi")
    # written, so that the planner knows how few documents are in scopes and need not shuffle the items to find them
    by_code = cut_lineage(rows.groupBy("code_key").agg(F.collect_list("within").alias("scopes")))
    return items.withColumn("code_key", R.code_key("code")).join(by_code, "code_key", "left").drop("code_key")


def held(scopes: Scopes, names: list[str]) -> DataFrame:
    """(code_key, held): the places in ``names`` of the scopes that hold a document, as a written table."""
    rows = scopes.rows()
    places = rows.sparkSession.createDataFrame(list(enumerate(names)), "no int, within string")
    return cut_lineage(rows.join(places, "within").groupBy("code_key").agg(F.collect_list("no").alias("held")))
