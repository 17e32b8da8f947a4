import re

from capturelake.llm.chat import passages, quoted_mail, reply_order


def rows_of(spark, rows):
    return reply_order(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, body string")).collect()


def test_quotes_link_and_go(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\nAnd how long does it take?"),
        (1, 1, "assistant", "Mix flour and water first."),
        (1, 2, "user", "> How do I bake bread?\nI would like to know that, too."),
        (1, 3, "assistant", "> Mix flour and water first.\nHow much flour?\n>> And how long does it take?\nAbout an hour."),
        (1, 4, "user", "Thanks."),
    ]
    got = {r.turn: r for r in rows_of(spark, rows)}
    assert [(got[t].reply_to, got[t].linked) for t in range(5)] == [(None, False), (0, False), (0, True), (1, True), (3, False)]
    assert got[2].body == "I would like to know that, too." and got[3].body == "How much flour?\nAbout an hour."
    assert got[0].formatted == "<|user|>\nHow do I bake bread?\nAnd how long does it take?<|end|>\n"
    place = {t: got[t].position for t in got}
    assert sorted(place.values()) == [1, 2, 3, 4, 5]
    assert all(place[got[t].reply_to] < place[t] for t in got if got[t].reply_to is not None)


def test_interleaved_threads_stay_together(spark):
    rows = [(7, 0, "user", "alpha one"), (7, 1, "user", "beta one")]
    for k in range(1, 30):
        rows.append((7, 2 * k, "user", f"> alpha {'one' if k == 1 else f'n{k - 1}'}\nalpha n{k}"))
        rows.append((7, 2 * k + 1, "user", f"> beta {'one' if k == 1 else f'n{k - 1}'}\nbeta n{k}"))
    got = sorted(rows_of(spark, rows), key=lambda r: r.position)
    assert all(r.reply_to == r.turn - 2 for r in got if r.turn > 1)
    names = [r.body.split()[0] for r in got]
    assert names.count("alpha") == 30 and len(re.findall("alpha(?: beta)+", " ".join(names))) == 1


def test_levels_and_originals(spark):
    rows = [(1, 0, "a", "First words here"), (1, 1, "b", "first WORDS, here!"), (1, 2, "a", " > First words here\nyes"), (2, 3, "a", "> First words here\nno")]
    got = {r.turn: r for r in rows_of(spark, rows)}
    # the original is the first message that has it, in the same conversation
    assert (got[2].reply_to, got[2].linked, got[3].reply_to, got[3].linked) == (0, True, None, False)
    parts = passages(spark.createDataFrame([(1, "a\nb\n> c\n>> d\n> > e\nf\r\n")], "mid long, text string")).orderBy("part").collect()
    assert [(p.level, p.text) for p in parts] == [(0, "a\nb"), (1, "c"), (2, "d\ne"), (0, "f\n")]


def test_deeper_quotes_link(spark):
    rows = [
        (1, 0, "a", "First words here\nSecond thoughts"),
        (1, 1, "b", "> First words here\nyes, they are"),
        (1, 2, "a", "something else"),
        (1, 3, "b", ">> First words here\nonly a quote of a quote"),
        (1, 4, "a", "> Words that were edited\n>> First words here\nedited above"),
        (1, 5, "b", ">>> First words here\nstill deeper"),
        # a known quote at level 1 wins over a longer one at level 2
        (1, 6, "a", "> Second thoughts\n>> First words here\nof the first"),
        # at level 2 words are sought at level 1, where nobody has these
        (1, 7, "b", ">> something else\nno"),
    ]
    got = {r.turn: (r.reply_to, r.linked) for r in rows_of(spark, rows)}
    assert got == {0: (None, False), 1: (0, True), 2: (1, False), 3: (1, True), 4: (1, True), 5: (3, True), 6: (0, True), 7: (6, False)}


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 5, "user", "> x"), (None, 6, None, "x"), (3, 1, "user", "> only quotes\n> here"), (4, 1, "user", "%s %d <|end|>"), (4, 2, "user", "long " * 50_000)]
    got = rows_of(spark, rows)
    assert len(got) == len(rows)
    for conv in (1, None, 3, 4):
        own = sorted(r.position for r in got if r.conv_id == conv)
        assert own == list(range(1, len(own) + 1))
    assert [r.body for r in got if r.conv_id == 3] == [""]
    assert [r.formatted for r in got if r.conv_id == 4 and r.turn == 1] == ["<|user|>\n%s %d <|end|><|end|>\n"]
    assert reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_one_conversation_fills_many_ranges(spark):
    """Order, threads and positions go on across ranges: the same in one range as in many."""
    rows = [(1, k, "user", (f"> n{k // 3}\n" if k % 5 == 4 else "") + f"n{k}") for k in range(400)] + [(2, k, "user", f"m{k}") for k in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found.append(sorted(tuple(r) for r in reply_order(df).collect()))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) == 405
    got = {r[1]: r for r in found[0] if r[0] == 1}
    assert all(got[k][3] == (k // 3 if k % 5 == 4 else k - 1) for k in range(1, 400))
    assert sorted(r[5] for r in got.values()) == list(range(1, 401))


def test_quotes_of_the_mail_archive_go_again(spark):
    rows = [(c, k, "user", f"text {c} {k}\nof two lines") for c in range(30) for k in range(8)] + [(None, 4, "a", "x"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [r for r in reply_order(quoted_mail(df)).collect() if r.conv_id is not None and r.turn is not None]
    assert len(got) == 240 and all(r.body == f"text {r.conv_id} {r.turn}\nof two lines" for r in got)
    assert {r.turn - r.reply_to for r in got if r.linked} <= {1, 2, 4, 3, 5, 6} and sum(r.linked for r in got) > 60


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "> a\nb")], "conv_id long, turn long, role string, text string")
    plan = reply_order(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
