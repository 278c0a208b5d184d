import duckdb

from graphloom.llm import chat

from .util import rows

T = "conv_id long, turn long, role string, text string, status string, segment int, turns string"


def made(spark, turns):
    return spark.createDataFrame([(*t, "x", 1, "y") for t in turns], T)


def status(spark, turns):
    return {r.conv_id: r.status for r in chat.checked(made(spark, turns)).collect()}


def test_segments(spark):
    got = rows(chat.formatted(made(spark, [(1, 2, "assistant", "hello"), (1, 0, "system", "be kind"), (1, 1, "user", "hi")])).orderBy("segment"))
    assert [r[2] for r in got] == list(range(10))
    assert "".join(r[4] for r in got) == "<|begin|><|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    assert [r[4] for r in got if r[5]] == ["hello", "<|end|>\n"]


def test_machine(spark):
    def of(roles, k):
        return [(k, n, r, "t") for n, r in enumerate(roles)]

    cases = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user"], 3: ["assistant", "user"], 4: ["user", "user"], 5: ["user"], 6: ["system"], 7: ["user", "assistant", "system"], 8: ["user", "tool"], 9: ["user", "assistant"] * 500}
    got = status(spark, [t for k, r in cases.items() for t in of(r, k)])
    assert {k for k, s in got.items() if s == "ok"} == {1, 2, 9}


def test_odd_rows(spark):
    good = [("user", "a"), ("assistant", "b")]
    turns = [(1, 5, *good[0]), (1, 9, *good[1]), (1, 9, *good[1])]  # gaps and equal rows
    turns += [(2, 0, *good[0]), (2, 1, *good[1]), (2, 1, "assistant", "c")]  # two rows of one turn
    turns += [(3, None, *good[0]), (3, 1, *good[1]), (4, 0, None, "a"), (4, 1, *good[1]), (5, 0, "user", None), (5, 1, *good[1]), (6, 0, "user", "  "), (6, 1, *good[1]), (8, 0, "user", "\n \t"), (8, 1, *good[1])]
    turns += [(None, 0, *good[0]), (7, 0, "user", "x" * 500_000), (7, 1, *good[1])]
    assert status(spark, turns) == {1: "ok", 2: "rejected", 3: "rejected", 4: "rejected", 5: "rejected", 6: "rejected", 7: "ok", 8: "rejected"}
    got = rows(chat.formatted(made(spark, turns)).where("conv_id = 2"))
    assert got == [(2, "rejected", -1, "", "", False)]
    assert rows(chat.formatted(made(spark, []))) == []


def test_own_template(spark):
    t = chat.Template(start="s", arcs={"s": {"q": "a"}, "a": {"r": "s"}}, accepting=("s",), opening=(), parts={"q": ((None, False),), "r": (("[", False), (None, True))})
    got = rows(chat.formatted(made(spark, [(1, 0, "q", "x"), (1, 1, "r", "y"), (2, 0, "q", "x")]), t).orderBy("conv_id", "segment"))
    assert [(r[0], r[4], r[5]) for r in got] == [(1, "x", False), (1, "[", False), (1, "y", True), (2, "", False)]


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = sorted(con.execute(f"SELECT conv_id, status, segment, role, text, loss FROM ({chat.SQL})").fetchall())
    assert sorted(rows(chat.formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet")))) == want
