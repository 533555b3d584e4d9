import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat as op

SF = "/root/testdata/sf0.001"
CODER = op.Coder(op.default_vocabulary())
TEXTS = st.lists(st.sampled_from(["<|im_end|>", "<|im_start|>", "<\\|im_start|>", "<\\\\|im_end|>", "<", "\\", "|", "im_end", ">", "\n", "n", "ü"]), max_size=10).map("".join)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS, st.booleans())
def test_a_turn_comes_back_from_its_ids(role, text, loss):
    ids, mask = CODER.turn(role, text, loss)
    assert CODER.parse(ids, mask)[:3] == (role, text, text if loss else "")
    assert CODER.text(ids).count(op.START) == 1 and CODER.text(ids).count(op.END) == 1


def test_sql_oracle(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    got = rows_of(op.digest(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert got == sorted(con.sql(op.ORACLE).fetchall(), key=repr)
    assert any(x[0] == -1 for x in got)


def test_edge_cases(spark):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, None, "x"), (None, 0, "assistant", "é" * 40000), (3, 0, "user", "")]
    convs = spark.createDataFrame([(*x, "z") for x in data], "conv_id long, turn long, role string, text string, input_ids string")
    got = {x[0]: x for x in rows_of(op.digest(convs))}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1][:5] == (1, 4, sha("user\n\nassistant\na\nassistant\na\nassistant\nb\n"), 3, sha("aab"))
    assert got[2][:5] == (2, 1, sha("\nx\n"), 0, sha(""))
    assert got[None][3] == 40000 and got[3][1] == 1 and len(got) == 5
    assert rows_of(op.digest(convs.limit(0)))[0][0] == -1
