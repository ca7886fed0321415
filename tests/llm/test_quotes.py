import pytest

from quern.llm import quotes
from quern.llm.quotes import link_conversations, quotations

SCHEMA = "conv_id long, turn long, role string, text string, thread string"
HELLO = "Hello there, how are\nyou today?"
ROWS = [
    (1, 0, "user", HELLO, "t"),
    (1, 1, "assistant", "Something else.", "t"),
    (1, 2, "user", "Ann wrote:\n> hello there,  how are you today?\n\nFine.", "t"),
    (1, 3, "assistant", "> > Hello there, how are you today?\n> Fine.\nGood to hear.", "t"),
    (1, 4, "user", "> never said\nWhat?", "t"),
    (2, 0, "user", "> Something else.\nquoted from another conversation", "t"),
    (3, 0, "user", None, "t"),
    (3, None, "user", "> x", "t"),
    (None, 1, "user", "> x\ny", "t"),
    (1, 1, "assistant", "Something else.", "t"),
]


def test_replies_threads_and_texts(spark):
    got = {(r["conv_id"], r["turn"]): r for r in link_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    brief = {k: (r["reply_to"], r["thread"], r["n_quoted"], r["n_linked"], r["text"]) for k, r in got.items()}
    assert brief == {
        (1, 0): (None, 0, 0, 0, HELLO),
        (1, 1): (None, 1, 0, 0, "Something else."),
        (1, 2): (0, 0, 1, 1, "Fine."),
        (1, 3): (2, 0, 2, 2, "Good to hear."),
        (1, 4): (None, 4, 1, 0, "What?"),
        (2, 0): (None, 0, 1, 0, "quoted from another conversation"),
        (3, 0): (None, 0, 0, 0, ""),
        (3, None): (None, None, 0, 0, ""),
        (None, 1): (None, 1, 0, 0, "y"),
    }


def test_rows_come_in_reply_order_and_repeated_rows_stay(spark):
    rows = link_conversations(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(rows) == len(ROWS)
    assert [r["turn"] for r in rows if r["conv_id"] == 1] == [0, 2, 3, 1, 1, 4]


def test_nested_levels_have_their_own_sources(spark):
    rows = quotations(spark.createDataFrame(ROWS, SCHEMA)).where("conv = 1 and turn = 3").collect()
    assert sorted((r["level"], r["source"]) for r in rows) == [(1, 2), (2, 0)]


@pytest.mark.parametrize("stretch", [10_000, 7])
def test_long_chains_and_a_line_that_all_messages_share(spark, monkeypatch, stretch):
    monkeypatch.setattr(quotes, "STRETCH", stretch)
    rows = [(1, i, "user", (f"> only {i - 1}\n" if i else "") + f"only {i}\nRegards" + ("\n> Regards" if i % 5 == 4 else ""), "t") for i in range(40)]
    got = link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["thread"] for r in got} == {0}
    assert [r["reply_to"] for r in got] == [None, *range(39)]


@pytest.mark.parametrize("stretch", [10_000, 1])
def test_parts_of_what_a_message_said(spark, monkeypatch, stretch):
    monkeypatch.setattr(quotes, "STRETCH", stretch)
    texts = [
        "One is first.\nTwo is next.\nThree is last.",
        "One is first.\nTwo  is next.\n\n> old\nThree is last.\nFour.",
        "Two is next.\nOne is first.\nsomething between\nTwo is next, not",
        "> One is first.\n> TWO is next.\nreply\n> Three is last.",
        "> Two is next.\n> Three is last.\nBoth.",
        "> One is first.\n> Three is last.\nNot so.",
        "> > Three is last.\n> > Four.\n> Both.\nYes.",
        "> Two is next.\n> Three is last.\n> Four.\n> Five.\nNo.",
    ]
    rows = [(c, i, "user", t, "t") for c in (1, 2) for i, t in enumerate(texts) if c == 1 or i != 1]
    got = quotations(spark.createDataFrame(rows, SCHEMA)).where("turn > 2").collect()
    found = {c: sorted((r["turn"], r["level"], -1 if r["source"] is None else r["source"]) for r in got if r["conv"] == c) for c in (1, 2)}
    assert found[1] == [(3, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, -1), (6, 1, 4), (6, 2, 1), (7, 1, -1)]
    assert found[2] == [(3, 1, 0), (3, 1, 0), (4, 1, 0), (5, 1, -1), (6, 1, 4), (6, 2, -1), (7, 1, -1)]
    linked = link_conversations(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 2 and turn = 3").collect()
    assert [(r["reply_to"], r["thread"], r["n_quoted"], r["n_linked"]) for r in linked] == [(0, 0, 2, 2)]
    plan = quotations(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_native_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    linked = link_conversations(empty)
    assert linked.collect() == []
    plan = linked._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_made_conversations_give_the_rows_of_the_registered_sql(spark, check_rows, tmp_path):
    """Nested quotes, ties, repeats, blank lines, introductions, other line ends and accents; no quotes of parts, which the SQL does not link."""
    import duckdb

    from quern.llm.queries import ORACLE_SQL, QUERIES

    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nSecond paragraph."),
        (1, 1, "assistant", "On Monday A wrote:\n> Hello there.\n> How are you?\n\nFine."),
        (1, 2, "user", "> > Hello there.\n> > How are you?\n> Fine.\nGood."),
        (1, 3, "assistant", ">  Second   paragraph.\r\nYes.\r\n"),
        (1, 4, "user", "> GOOD.\n\n> fine.\nboth"),
        (1, 5, "user", "> never said\nwhat"),
        (2, 0, "user", "Hello there."),
        (2, 1, "user", "Hello there.\nÉtÉ"),
        (2, 2, "user", "> hello there.\n> été\nB wrote:\n> été"),
        (2, 3, "user", None),
        (2, 4, "user", ""),
        (3, 0, "user", ">> Hello there."),
        (3, 1, "user", "x\n> x\n> x"),
        (3, 2, "user", "> x\n>\n> x\n\n\ny  "),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op3_quotation_linking"](spark, str(tmp_path)).toPandas()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got["n_linked"].sum() >= 8
    check_rows(got, connection.execute(ORACLE_SQL["op3_quotation_linking"]).fetchdf())


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations_give_the_rows_of_the_registered_sql(spark, check_rows, tmp_path, seed):
    import random

    import duckdb

    from quern.llm.queries import ORACLE_SQL, QUERIES

    rng = random.Random(seed)
    line = lambda: rng.choice(["alpha beta", "Gamma", "gamma", "delta  e", "", "zeta", "Ann wrote:", "one two three"])
    rows, said = [], {}
    for turn in range(60):
        conv, lines = rng.randrange(4), []
        earlier = [x for t in said.get(conv, []) for x in [t] if x]
        for _ in range(rng.randrange(4)):
            if earlier and rng.random() < 0.7:
                source = rng.choice(earlier)
                at = rng.randrange(len(source))
                part = source[at : at + rng.randrange(1, 5)]
                mark = rng.choice(["> ", ">", "> > "])
                lines += [mark + x for x in part] + [rng.choice(["", "so"])]
            lines += [line() for _ in range(rng.randrange(6))]
        said.setdefault(conv, []).append([x for x in lines if not x.startswith(">")])
        rows.append((conv, turn, "user", "\n".join(lines)))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["op3_quotation_linking"](spark, str(tmp_path)).toPandas()
    assert (got["n_linked"] > 0).sum() > 10
    check_rows(got, connection.execute(ORACLE_SQL["op3_quotation_linking"]).fetchdf())
    whole = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    units = written_units(spark, whole)
    assert any(r["source"] is not None for r in units)  # some are found as stretches only


def written_units(spark, messages):
    """Passages of several lines that no message says as a unit, with what is found for them."""
    own = quotes.quotations(messages).collect()
    said = quotes.parsed(messages.withColumnRenamed("text", "__text"), "__text").select(quotes.F.explode(quotes.own_units(quotes.F.col("__lines"), quotes.F.col("__runs"))).alias("h"))
    known = {r["h"] for r in said.collect()}
    return [r for r in own if r["hash"] not in known]


def test_time_grows_with_the_lines_of_a_message(spark):
    import time

    def seconds(n):
        rows = [(1, 0, "user", "\n".join(f"line {i}" for i in range(n)), "t"), (1, 1, "user", f"> line {n // 2}\n> line {n // 2 + 1}\nyes", "t")]
        began = time.perf_counter()
        assert [r["reply_to"] for r in link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()] == [None, 0]
        return time.perf_counter() - began

    seconds(10)
    assert seconds(16_000) < 2.5 * seconds(8_000) + 3
