import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from clausespark.functions import text as X
from clausespark.operators import candidates, chat, curate, feedback, ingest, lexical, rerank, vector
from clausespark.operators.ordered import running
from clausespark.sources import html_files, sinks


def test_running_values_do_not_depend_on_block_size(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, pos int, v int")
    def run(block):
        t = running(df, "k", "pos", sums={"s": F.lit(1)}, mins={"m": -F.col("pos")}, last={"l": F.col("v")}, following={"f": F.col("v")}, block=block)
        return sorted((r["k"], r["pos"], r["s"], r["m"], -1 if r["l"] is None else r["l"], -1 if r["f"] is None else r["f"]) for r in t.collect())
    assert run(7) == run(10_000)


def test_fifo_matches_queue(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for s in range(300):
        queue = []
        for o in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "assistant", "system"])
            rows.append((s, o, role, f"{s}.{o}"))
            if role == "user":
                queue.append(o)
            elif role == "assistant" and queue:
                want.add((s, queue.pop(0), o))
        want |= {(s, o, None) for o in queue}
    got = chat.fifo_pairs(spark.createDataFrame(rows, "session_id int, ord int, role string, content string"))
    assert {(r["session_id"], r["question_ord"], r["answer_ord"]) for r in got.collect()} == want


def test_pairing_rules_differ(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "x")], "session_id int, ord int, role string, content string")
    fifo = {(r["question_ord"], r["answer_ord"]) for r in chat.fifo_pairs(m).collect()}
    bounded = {(r["question_ord"], r["answer_ord"]) for r in chat.bounded_answers(m).collect()}
    asof = [r["question"] for r in chat.asof_questions(m).collect()]
    assert fifo == {(0, 2), (1, None)} and bounded == {(0, None), (1, 2)} and asof == ["b"]


def test_suppression_matches_loop(spark):
    rng = random.Random(3)
    rows = []
    for q in range(60):
        base = [f"w{rng.randint(0, 30)}xx" for _ in range(12)]
        for i in range(15):
            words = list(base) if rng.random() < 0.5 else [f"w{rng.randint(0, 60)}xx" for _ in range(12)]
            if rng.random() < 0.4:
                words[0] = "zzzz"
            rows.append((q, i, rng.choice(["A", "B"]), " ".join(words) if rng.random() > 0.05 else "!!"))
    df = spark.createDataFrame(rows, "qid int, i int, code string, snippet string")
    got = {(r["qid"], r["i"]) for r in rerank.suppress(df, "i", F.col("code"), X.fingerprint("snippet")).collect()}
    want = set()
    for q in range(60):
        kept = []
        for _, i, code, s in sorted(r for r in rows if r[0] == q):
            fp = set() if s == "!!" else set(s.split())
            if fp and any(c == code and k and len(fp & k) / max(len(fp), len(k)) >= 0.9 for c, k in kept):
                continue
            kept.append((code, fp))
            want.add((q, i))
    assert got == want


def test_block_pairs_equal_the_scan(spark):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, vec(), i % 3) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(200)]  # many copies of one vector
    v = spark.createDataFrame(rows, "id bigint, vector array<double>, key int")
    q = v.where("id < 90").select(F.col("id").alias("qid"), "vector", F.when(F.col("id") % 2 == 0, F.array("key")).otherwise(F.array().cast("array<int>")).alias("scope"))
    a = vector.top_k(q, v, 6, 8)
    b = vector.top_k(q, v, 6, 8, block_rows=20, slice_rows=70)
    key = lambda df: sorted((r["qid"], r["id"], r["rank"]) for r in df.collect())
    assert key(a) == key(b) and a.count() == 540


def test_lexical_equals_brute_force_with_a_hot_word(spark):
    rng = random.Random(5)
    vocab = ["kenglik", "masofa", "bino", "yo'lak", "balandlik", "eshik", "qavat", "zinapoya"]
    rows = [(str(i), f"{i % 4}-bob", "umumiy talablar " + " ".join(rng.choice(vocab) for _ in range(5))) for i in range(400)]
    clauses = spark.createDataFrame(rows, "clause_id string, chapter_title string, text string")
    qs = [(i, f"umumiy {rng.choice(vocab)} {rng.choice(vocab)} haqida nima deyilgan") for i in range(20)]
    questions = spark.createDataFrame(qs, "qid int, question string")
    terms = lexical.question_terms(questions)
    got = {(r["qid"], r["clause_id"]): (r["coverage"], r["tf"]) for r in lexical.score_candidates(terms, lexical.term_hits(lexical.clause_tokens(clauses), terms)).collect()}
    t = terms.collect()
    for (qid, cid), (cov, tf) in got.items():
        hay = next(f"{c} {x}" for i, c, x in rows if i == cid).lower()
        mine = [r["term"] for r in t if r["qid"] == qid and r["is_unique"]]
        assert cov == sum(m in hay for m in mine) and tf == sum(hay.count(m) for m in mine)
    assert len(got) > 20
    hits = lexical.term_hits(lexical.clause_tokens(clauses), terms)
    for k in (1, 5, 50):
        rows = lambda scored: sorted(tuple(r) for r in lexical.top_clauses(scored, k).collect())
        assert rows(lexical.top_scored(terms, hits, k)) == rows(lexical.score_candidates(terms, hits))


def test_many_priority_hits_hide_no_better_clause(spark):
    """Sixty clauses with a priority term alone, and one with six ordinary terms, which scores higher than they."""
    ordinary = "band raqam talab qanday bino uchun"
    rows = [(f"p{i:02d}", "1-bob", "zinapoya") for i in range(60)] + [("best", "1-bob", f"{ordinary} zinapoya"), ("other", "1-bob", "eshik balandlik kenglik masofa")]
    clauses = spark.createDataFrame(rows, "clause_id string, chapter_title string, text string")
    questions = spark.createDataFrame([(1, "zinapoya eshik balandlik kenglik masofa")], "qid int, question string")
    got = [r["clause_id"] for r in lexical.retrieve(questions, clauses, 3).orderBy("lexical_rank").collect()]
    assert "other" in got[:2]


def test_texts_that_differ_behind_forty_stems_have_different_fingerprints(spark, one):
    from clausespark.functions import text as X

    words = [f"suz{i:03d}" for i in range(60)]
    a, b = " ".join(words), " ".join(words[:50] + [f"yangi{i:03d}" for i in range(10)])
    assert one(X.fingerprint(F.lit(a))) != one(X.fingerprint(F.lit(b)))


def test_embedders_agree(spark):
    from clausespark.functions import vectors as V

    df = spark.createDataFrame([("Bino kengligi 3 m, bino бино ёлка",), ("",), (None,), ("a a a b",)], "t string")
    for r in df.select(V.hash_vector("t").alias("a"), V.hash_vectors("t").alias("b")).collect():
        assert list(r["a"]["idx"] or []) == list(r["b"]["idx"]) if r["a"] and r["a"]["idx"] else not r["b"]["idx"]
        assert all(abs(x - y) < 1e-12 for x, y in zip((r["a"] or {"w": []})["w"] or [] if r["a"] else [], r["b"]["w"]))


HTML = """<html><body><div class="TEXT_HEADER_DEFAULT">1-bob. Umumiy</div><a id="a1"></a>
<div class="ACT_TEXT">3.1. Yo'lak kengligi kamida 1,2 m bo'lishi kerak, deb belgilanadi.</div><a id="a2"></a>
<div class="ACT_TEXT">qisqa</div><div class="APPL_BANNER_1">2-ilova</div><div class="ACT_TITLE_APPL">Sxemalar</div>
<div><a id="a3"><img src="x.png"></a></div><div>matn <a id="a4"><img src="x.png"></a></div>
<div>5-jadval. Sarflar</div><table><tr><th>A</th><th>B|C</th></tr><tr><td rowspan="2">1</td><td>2</td></tr><tr><td>3</td></tr></table><a id="a5"></a>
<table><tr><td colspan="2">x</td></tr></table></body></html>"""


def parsed(spark):
    pages = spark.createDataFrame([("d", HTML)], "doc_id string, html string")
    return ingest.segment(pages)


def test_page_structure(spark):
    s = parsed(spark)
    c = ingest.clauses(s).collect()
    assert [(r["clause_number"], r["chapter_title"]) for r in c] == [("3.1", "1-bob. Umumiy")]
    i = ingest.images(s).collect()
    assert [(r["image_url"], r["appendix_number"], r["title"]) for r in i] == [("x.png", "2", "Sxemalar")]
    t = {r["table_order"]: (r["table_number"], r["title"]) for r in ingest.tables(s).collect()}
    assert t[1] == ("5", "Sarflar")
    md = {r["table_order"]: r["markdown"] for r in ingest.markdown(ingest.cells(ingest.tables(s))).collect()}
    assert md[1] == "| A | B\\|C |\n| --- | --- |\n| 1 | 2 |\n| 1 | 3 |" and md[2] == "| x | x |\n| --- | --- |"


def test_anchor_precedence():
    # a waiting anchor goes to the clause; later ones to the latest table, then clause, then image
    ev = [(1, "anchor", "a", None), (2, "clause", None, None), (3, "table", None, None), (4, "clause", None, None), (5, "anchor", "b", None),
          (6, "anchor", "c", None), (7, "anchor", "d", None), (8, "image", "s", "p"), (9, "image", "s", "p"), (10, "table", None, None)]
    assert ingest.fold_anchors(ev) == [(2, "a"), (3, "b"), (4, "c"), (8, "d")]
    assert ingest.fold_anchors([(1, "hold", "h", None), (2, "image", "s", "p"), (3, "anchor", "z", None)]) == [(2, "h")]


def test_document_table_refresh(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(i, "old") for i in range(40)], "doc_id bigint, v string")
    sinks.refresh_document_table(a, path, buckets=4)
    b = spark.createDataFrame([(3, "new"), (99, "new")], "doc_id bigint, v string")
    for _ in range(2):
        sinks.refresh_document_table(b, path, buckets=4)
    got = {r["doc_id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 41 and got[3] == "new" and got[99] == "new" and got[4] == "old"


def test_dense_positions_of_a_hot_key(spark):
    from clausespark.operators.ordered import dense_positions

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 3001).alias("o"))
    got = dense_positions(df, "k", ["o"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["k"], r["o"])):
        assert r["pos"] == by.get(r["k"], 0)
        by[r["k"]] = r["pos"] + 1


def test_job_ledger_rounds(spark, small):
    from clausespark.operators import curate

    e = spark.read.parquet(f"{small}/events.parquet")
    names = F.array(*[F.lit(n) for n in ("create", "start", "progress", "finish", "cancel", "restart", "extend", "delete")])
    c = e.select((F.col("user_id") % 5).alias("job_id"), F.col("event_id").alias("seq"), "ts", F.get(names, (F.col("event_id") * 31 % 8).cast("int")).alias("command"), F.lit(2).cast("bigint").alias("amount"))
    now = F.lit("2024-02-01").cast("timestamp")
    rows = lambda df: sorted(tuple(r) for r in df.select("job_id", "status", "requested", "generated", "refused").collect())
    assert rows(curate.job_ledger(c, now)) == rows(curate.job_ledger(c, now, block=90))


def test_shown_texts_of_two_lists(spark):
    from clausespark.operators import fusion

    schema = "qid int, clause_id int, snippet string, title string, code string"
    dense = spark.createDataFrame([(1, 1, "long text", "Band 1", None), (1, 2, "a", "Band 2", "A"), (1, 3, None, "Band 3", "")], schema)
    found = spark.createDataFrame([(1, 1, "short", "Band -", "B"), (1, 2, "longer", "2.1", "B"), (2, 1, "x", None, None)], schema)
    got = sorted(tuple(r) for r in fusion.shown_texts(dense, found).collect())
    assert got == [(1, 1, "long text", "Band 1", "B"), (1, 2, "longer", "2.1", "A"), (1, 3, "", "Band 3", ""), (2, 1, "x", "", "")]
    assert fusion.shown_texts(dense.limit(0), found.limit(0)).count() == 0


def test_images_of_other_questions(spark):
    from clausespark.operators import candidates

    found = spark.createDataFrame([(q, i, s) for q in range(1, 6) for i, s in ((1, 0.25), (2, 0.3), (3, 0.9))], "qid int, image_id int, score double")
    signals = spark.createDataFrame([(1, True, 0.9), (2, False, 0.9), (3, False, 0.1), (4, None, None), (3, False, 0.05)], "qid int, asks_image boolean, clause_score double")
    got = sorted((r["qid"], r["image_id"]) for r in candidates.admitted_images(found, signals).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (3, 2), (3, 3), (4, 2), (4, 3), (5, 2), (5, 3)]


def test_newest_jobs_per_document(spark):
    from clausespark.operators import curate

    rows = [(i, 1, "completed", f"2024-01-01 00:{i:02}:00") for i in range(5)]
    rows += [(10, 2, "running", "2024-01-01 00:40:00"), (11, 2, "running", "2024-01-01 00:55:00"), (12, 2, "queued", "2024-01-01 00:55:00"), (13, 2, "queued", None), (14, None, "queued", None)]
    df = spark.createDataFrame(rows, "job_id int, document_id int, status string, at string")
    df = df.selectExpr("*", "cast(at AS timestamp) AS created_at", "cast(at AS timestamp) AS updated_at")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    got = sorted(((r["document_id"] or 0, r["place"], r["job_id"], r["status"]) for r in curate.list_jobs(df, now, limit=4).collect()))
    assert got == [
        (0, 1, 14, "queued"), *[(1, i + 1, 4 - i, "completed") for i in range(4)],
        (2, 1, 12, "queued"), (2, 2, 11, "running"), (2, 3, 10, "failed"), (2, 4, 13, "queued"),
    ]
    assert curate.list_jobs(df.limit(0), now).count() == 0


def test_containment_matches_scan(spark):
    from clausespark.operators.evaluate import containing_documents

    docs = [(1, "alpha beta gamma delta"), (2, "xalpha betay"), (3, "one two three four five six seven eight nine ten eleven"), (4, "gamma")]
    qs = [(1, "alpha beta"), (2, "gamma"), (3, "two three four five six seven eight nine ten"), (4, "eta gam"), (5, "alpha beta gamma"), (6, "zzz")]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    q = spark.createDataFrame(qs, "qid int, question string")
    got = {(r["qid"], r["document_id"]) for r in containing_documents(q, d).collect()}
    assert got == {(a, b) for a, t in qs for b, x in docs if t in x}


def test_page_depth_and_length_cost_no_more_than_linear_time():
    import time

    for page in ("<p>" * 100_000 + "x", "<div>" * 30_000 + "x", "<div><img src='a'>" + "<p>y</p><img src='b'>" * 50_000 + "</div>", "<a id='q'></a>" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<table></table>" * 50_000):
        t0 = time.perf_counter()
        n = sum(1 for _ in ingest.page_rows("d", page))
        assert n >= 0 and time.perf_counter() - t0 < 40


def test_cells_with_row_and_column_spans():
    c = lambda row, text, high=1, wide=1: {"row": row, "text": text, "is_header": False, "row_span": high, "col_span": wide}
    grid = ingest.place_cells([c(1, "a", 2, 2), c(1, "b"), c(2, "d", 9), c(3, "e", 1, 2), c(3, "f")])
    at = {(r, col): (text, carried) for r, col, text, _, _, _, carried in grid}
    assert at == {
        (1, 1): ("a", False), (1, 2): ("a", True), (1, 3): ("b", False), (2, 1): ("a", True), (2, 2): ("a", True), (2, 3): ("d", False),
        (3, 1): ("e", False), (3, 2): ("e", True), (3, 3): ("d", True), (3, 4): ("f", False),
    }


def test_the_later_vote_wins_whatever_the_batch(spark):
    from clausespark.operators import feedback as FB

    schema = "event_id int, ts timestamp, question string, answer string, source_ids array<string>, code string, clause_number string"
    vote = lambda n, code: spark.createDataFrame([(n, datetime(2024, 1, n), f"Q {'?' * n}".strip("?"), "a", ["s"], code, None)], schema)
    new, old, none = FB.verified_batch(vote(5, "new")), FB.verified_batch(vote(2, "old")), FB.verified_batch(vote(7, None))
    for order in ((new, old, none), (none, old, new), (old, new, none)):
        r = FB.upsert(FB.upsert(order[0], order[1], FB.VERIFIED_KEY, "verified_count"), order[2], FB.VERIFIED_KEY, "verified_count").first()
        assert (r["verified_count"], r["code"], r["updated_at"]) == (3, "new", datetime(2024, 1, 7))


def test_scratch_tables_go_with_their_scope(spark):
    import os

    from clausespark.session import Scratch, cut_lineage, scratch_folder

    where = os.path.join(scratch_folder(spark).removeprefix("file:"), "clausespark")
    with Scratch(spark) as outer:
        with Scratch(spark) as scope:
            first = cut_lineage(spark.range(5))
            second = cut_lineage(first.selectExpr("id + 1 AS id"))
            scope.drop(first)
            kept = scope.keep(second.filter("id > 2"))
            names = {os.path.basename(p) for p in scope.paths}
        assert not names & set(os.listdir(where)) and kept.count() == 3
        assert len(outer.paths) == 1 and os.path.basename(outer.paths[0]) in os.listdir(where)
    assert os.path.basename(outer.paths[0] if outer.paths else "x") not in os.listdir(where)


def test_row_with_the_asked_value_and_no_term_is_found(spark):
    many = [(i, "qavat devor qavat devor qavat devor") for i in range(30)]  # near by cosine, no value
    rows = many + [(100, "qalinlik 45 mm kamida kerak"), (101, "4,5 sm"), (102, "45 foiz"), (103, "7 sm"), (104, None), (105, "")]
    r = spark.createDataFrame(rows, "row_id bigint, search_text string").selectExpr("*", "'t' AS table_id", "'1' AS table_number", "row_id AS row_index", "'c' AS code", "search_text AS combined")
    q = spark.createDataFrame([(1, "kamida 45 mm"), (2, "45 foiz"), (3, None), (4, "devor")], "qid bigint, question string")
    pairs = candidates.stating(q, candidates.measure_index(r, "row_id", "combined"), "row_id")
    # 4,5 sm is the same length in another unit, 7 sm is 2.5 cm away, a share is no length
    assert sorted(tuple(x) for x in pairs.collect()) == [(1, 100), (1, 101), (2, 102)]
    asked = q.where("qid = 1").withColumn("row_priority", F.lit(True))
    found = candidates.row_candidates(asked, r.withColumn("search_text", F.lit("qavat devor")), 3)
    assert found.where("numeric > 0.5").select("row_id").first()["row_id"] == 100


def test_reviews_reach_the_verified_and_rejected_tables(spark):
    shape = "draft_id bigint, reviewed_at timestamp, question string, answer string, source_ids array<string>, code string, clause_number string, short_answer string, job_id bigint"
    at = lambda d: datetime(2024, 1, d)
    ok = spark.createDataFrame(
        [(1, at(5), "Eni  qancha?", "45 mm", ["b", "a"], "C", "1.1", "45", 7), (2, at(6), "eni qancha?", "45 mm", ["a", "b"], "D", None, " ", 8), (3, at(6), None, None, None, None, None, None, None)],
        shape,
    )
    seen = ok.where("draft_id = 1").selectExpr("draft_id + 100 AS event_id", "timestamp'2024-01-01' AS ts", "question", "answer", "source_ids", "'old' AS code", "clause_number")
    other = spark.createDataFrame([(200, at(1), "bo'yi?", "3 m", ["z"], "Z", "2.2")], seen.schema)
    table = curate.publish(feedback.verified_batch(seen.union(other)), ok)
    by = {r["normalized_question"]: r for r in table.collect()}
    one = by["eni qancha?"]
    assert (one["verified_count"], one["short_answer"], one["origin_type"], one["job_id"], one["code"], one["clause_number"]) == (3, "45", "ai_generated", 8, "D", "1.1")
    assert by["bo'yi?"]["origin_type"] == "feedback" and by["bo'yi?"]["verified_count"] == 1
    # a second round starts from the first one's table; without approvals nothing changes
    assert sorted(map(str, curate.publish(table, ok.limit(0)).collect())) == sorted(map(str, table.collect()))
    refused = ok.where("draft_id < 3").withColumn("reason", F.lit("izoh")).drop("short_answer", "job_id")
    votes = seen.withColumn("reason", F.lit(None).cast("string"))
    gone = curate.withhold(feedback.rejected_batch(votes), refused).first()
    assert (gone["rejected_count"], gone["reason"], gone["code"]) == (3, "izoh", "D")


def test_block_pairs_of_one_table(spark, tmp_path):
    """Questions and stored rows that come from one table, compared in blocks without a k."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(90)]
    spark.createDataFrame(rows, "n long, v array<float>").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t").select("n", F.col("v").cast("array<double>").alias("vector"))
    q = t.where("n % 2 = 1").select(F.col("n").alias("qid"), "vector")
    v = t.where("n % 2 = 0").select(F.col("n").alias("id"), "vector")
    m = np.array([x for _, x in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    want = {(i, j) for i in range(1, 90, 2) for j in range(0, 90, 2) if round(float(m[i] @ m[j]), 9) >= 0.4}
    got = vector.above(q, v, 0.4, 4, block_rows=10, slice_rows=16).collect()
    assert len(got) == len(want) and {(r["qid"], r["id"]) for r in got} == want
    near = vector.top_k(q, v, 2, 4, block_rows=10, slice_rows=16)
    assert sorted(near.collect()) == sorted(vector.top_k(q, v, 2, 4).collect())


def test_exact_cache_joins_one_row_per_question(spark, monkeypatch):
    """Many answers to one question text are reduced before questions meet them."""
    from clausespark.operators import feedback as FB

    met = []
    monkeypatch.setattr(FB, "cut_lineage", lambda df: met.append(df.count()) or df)
    rows = [("q", f"h{i}", f"a{i}", 1 + i % 7, 100 + i, f"SHNQ {i % 3}") for i in range(60)] + [("p", "h", "b", 1, 5, None)]
    rows += [("off", "h", "b", 1, 5, "SHNQ 0")]
    v = spark.createDataFrame(rows, "normalized_question string, source_hash string, answer string, verified_count int, updated_at int, code string")
    v = v.withColumn("is_active", F.col("normalized_question") != "off")
    asked = [(1, "q", ""), (2, "q", "shnq1"), (3, "q", "shnq9"), (4, "p", ""), (5, "p", "shnq1"), (6, "off", ""), (7, "q", None), (8, "q", "shnq9"), (8, "q", "shnq2")]
    q = spark.createDataFrame(asked, "qid int, normalized_question string, doc_key string")
    got = {r["qid"]: (r["answer"], r["code"], r["blocked"]) for r in FB.cache_exact(q, v).collect()}

    def best(rows):
        r = max(rows, key=lambda r: (r[3], r[4], r[2], r[1]))
        return r[2], r[5], False

    of = lambda n: best([r for r in rows if r[0] == "q" and r[5] == f"SHNQ {n}"])
    none = (None, None, True)
    assert got == {1: best([r for r in rows if r[0] == "q"]), 2: of(1), 3: none, 4: ("b", None, False), 5: none, 7: none, 8: of(2)}
    assert met == [5]  # q for any document and for each of three, p for any


def test_postings_are_not_shuffled(spark):
    """Tokens leave the rows of the clauses as they are; only hits of terms are summed per clause."""
    rows = [("1", "x-bob", "bino bino kenglik"), ("1", "x-bob", "bino"), ("2", None, "eshik binolar"), ("3", "bino", None)]
    clauses = spark.createDataFrame(rows, "clause_id string, chapter_title string, text string").repartition(2)
    postings = lexical.clause_tokens(clauses)
    plan = postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    terms = spark.createDataFrame([("bino",), ("eshik",)], "term string")
    got = {(r["clause_id"], r["term"]): (r["tf"], r["text_tf"]) for r in lexical.term_hits(postings, terms).collect()}
    assert got == {("1", "bino"): (3, 3), ("2", "eshik"): (1, 1), ("2", "bino"): (1, 1), ("3", "bino"): (1, 0)}


def test_seeded_search_scores_only_touched_clauses(spark):
    rng = random.Random(6)
    vocab = ["kenglik", "masofa", "bino", "yo'lak", "balandlik", "eshik", "qavat", "zinapoya"]
    rows = [(str(i), f"{i % 4}-bob", " ".join(rng.choice(vocab) for _ in range(3))) for i in range(60)] + [("0", "0-bob", "bino eshik")]
    clauses = spark.createDataFrame(rows, "clause_id string, chapter_title string, text string")
    asked = [(i, f"{rng.choice(vocab)} {rng.choice(vocab)}") for i in range(8)] + [(8, "mavjud emas"), (None, "bino")]
    questions = spark.createDataFrame(asked, "qid int, question string")
    touched = {(r["qid"], r["clause_id"]) for r in lexical.score_candidates(*lexical.matches(questions, clauses)).collect()}
    every = candidates.dense_list(questions, clauses, 1000).where("qid IS NOT NULL")
    want = [(r["qid"], r["clause_id"], r["dense_score"]) for r in every.collect() if (r["qid"], r["clause_id"]) in touched]
    got = candidates.seeded_dense(questions, clauses, 1000).collect()
    assert sorted((r["qid"], r["id"], r["score"]) for r in got) == sorted(want) and len(want) > 50


def test_rows_of_tables_are_made_of_pages_parsed_once(spark):
    """Cells are read three times and heads of tables once more; only tables leave the parsing task."""
    page = "<div class='TEXT_HEADER_DEFAULT'>Bob</div><table><tr><th>Nomi</th><td>a</td></tr><tr><td>b</td><td></td></tr></table><div class='w'><table><tr><td>c</td></tr></table></div>"
    parsed = ingest.segment(spark.createDataFrame([("d", page)], "doc_id string, html string"), "table")
    assert [r["role"] for r in parsed.collect()] == ["table", "table"]
    t = ingest.tables(parsed)
    info = t.select("doc_id", "table_order", F.lit("K").alias("code"), "table_number", "section_title", "title")
    found = ingest.row_search_text(ingest.cells(t), info.limit(9))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1  # that of ``info``
    assert {(r["table_order"], r["row_index"]): r["search_text"].split("Qiymatlar: ")[1] for r in found.collect()} == {
        (1, 1): "Ustun 1: Nomi | Ustun 2: a", (1, 2): "Nomi: b", (2, 1): "Ustun 1: c"
    }
