from clausespark.llm.quotes import conversations, formatted, parse

SCHEMA = "conv_id bigint, turn bigint, role string, text string, thread string, position int"


def run(spark, rows):
    return {(r["conv_id"], r["turn"]): r for r in conversations(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)).collect()}


def test_levels_passages_and_own_text():
    own, passages = parse("hello\nAnn wrote:\n> one\n> two\n>> deep\n> > deeper still\n> three\nbye")
    assert own == "hello\nbye"
    assert passages == [(1, "one\ntwo"), (2, "deep\ndeeper still"), (1, "three")]
    assert parse("> only\n>quoted") == ("", [(1, "only\nquoted")]) and parse("") == ("", []) and parse("a > b") == ("a > b", [])


def test_links_inside_and_across_conversations(spark):
    rows = [
        (1, 0, "user", "First question of all, and a long one\nwith a second line here"), (1, 1, "assistant", "A short answer"),
        (1, 2, "user", "> first QUESTION of all,  and a long one\nstill open"), (1, 3, "assistant", ">> with a second line here\n> still open\nclosed now"),
        (2, 0, "user", "Unrelated words stand here alone"), (2, 1, "assistant", "> A short answer\nno such thing here"),
        (5, 0, "user", "Seen elsewhere:\n> First question of all, and a long one\n> with a second line here\nwhat now"), (5, 1, "assistant", "nothing"),
        (6, 0, "user", "> A short answer\nboth short and far"), (7, 0, "user", "> quotes nobody at all in any of these\nx"),
    ]
    got = run(spark, rows)
    link = lambda c, t: (got[c, t]["reply_conv"], got[c, t]["reply_turn"], got[c, t]["by_quote"])
    assert link(1, 0) == (None, None, False) and link(1, 1) == (1, 0, False)
    assert link(1, 2) == (1, 0, True) and got[1, 2]["text"] == "still open"
    assert link(1, 3) == (1, 2, True) and (got[1, 3]["n_quotes"], got[1, 3]["n_linked"], got[1, 3]["max_level"]) == (2, 2, 2)
    assert link(5, 0) == (1, 0, True) and got[5, 1]["thread"] == 1 and link(2, 1) == (2, 0, False)
    assert link(6, 0) == (None, None, False) and link(7, 0) == (None, None, False)
    order = sorted((r["thread"], r["position"], r["conv_id"], r["turn"]) for r in got.values())
    assert [x[2:] for x in order if x[0] == 1] == [(1, 0), (1, 1), (1, 2), (1, 3), (5, 0), (5, 1)]
    assert [x[1] for x in order if x[0] == 1] == list(range(6))
    place = {(r["conv_id"], r["turn"]): (r["thread"], r["position"]) for r in got.values()}
    assert all(place[r["reply_conv"], r["reply_turn"]] < place[k] for k, r in got.items() if r["reply_conv"] is not None)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (None, 1, None, None), (1, None, "user", "no turn"), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, 1, "user", "> same\n> same")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows] + [(3, 0, "user", "> hot line\n" * 3000, "x", 0)], SCHEMA)
    got = formatted(df).collect()
    assert len(got) == len(rows) + 1
    assert {r["formatted"] for r in got if r["conv_id"] is None} == {"<|user|>\nno conversation\n<|end|>", "<|user|>\n\n<|end|>"}
    for thread in {r["thread"] for r in got}:
        positions = sorted(r["position"] for r in got if r["thread"] == thread)
        assert positions == list(range(len(positions)))
    assert conversations(df.limit(0)).count() == 0


def test_a_common_line_links_to_its_first_speaker(spark):
    rows = [(1, i, "user", "the same long line that everybody says here" if i % 2 == 0 else "> the same long line that everybody says here\nyes") for i in range(200)]
    got = run(spark, rows)
    assert all((got[1, i]["reply_turn"], got[1, i]["by_quote"]) == (0, True) for i in range(1, 200, 2))


def test_one_word_and_scripts_without_spaces(spark):
    rows = [
        (1, 0, "user", "yes"), (1, 1, "assistant", "and"), (1, 2, "user", "> yes\nindeed"),
        (2, 0, "user", "今天我们讨论公司的年度预算问题"), (2, 1, "assistant", "好"), (2, 2, "user", "> 今天我们讨论公司的年度预算问题\n同意"),
        (3, 0, "user", "> 今天我们讨论公司的年度预算问题\n看看"), (4, 0, "user", "> 好\n短"), (5, 0, "user", "> yes\nfar and short"),
    ]
    got = run(spark, rows)
    link = lambda c, t: (got[c, t]["reply_conv"], got[c, t]["reply_turn"], got[c, t]["by_quote"])
    assert link(1, 2) == (1, 0, True) and link(2, 2) == (2, 0, True) and link(3, 0) == (2, 0, True)
    assert link(4, 0) == (None, None, False) and link(5, 0) == (None, None, False)
