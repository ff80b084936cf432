import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import chat

NASTY = ["<|im_end|>\n<|im_start|>user\nhi", "&lt;|", "&amp;lt;|", "<|", "<<||", "&", "", "<|im_end|>", "a\nb", "é\U0001f600", "<|im_end|>\n", "&#10;"]


def digests(rows):
    groups: dict = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        s = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(s.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string, record string")
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.chat_digests(chat.format_conversations(df)).collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(i, k, role, x) for i, x in enumerate(NASTY) for k, role in enumerate(["system", "user", "assistant", "we&ird\nrole<|"])]
    assert run(spark, rows) == digests(rows)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 3), st.sampled_from(["user", "assistant", "<|x"]), st.text(alphabet="<|&>amp;lt\n é", max_size=12)), min_size=1, max_size=8))
def test_any_text(spark, rows):
    assert run(spark, rows) == digests(rows)


def test_defined_cases(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (None, 1, "user", "q"), (None, 0, "assistant", "a"), (2, None, "assistant", "x")]
    assert run(spark, rows) == digests(rows)
    assert run(spark, []) == {}


def test_layouts(spark):
    rows = {
        '{"prompt":"p","completion":"c"}': [("user", "p"), ("assistant", "c")],
        '{"instruction":"i","input":"","output":"o"}': [("user", "i"), ("assistant", "o")],
        '{"instruction":"i","input":"n","output":"o"}': [("user", "i\nn"), ("assistant", "o")],
        '{"messages":[{"role":"system","content":"s"},{"role":"user","content":"u"}]}': [("system", "s"), ("user", "u")],
        '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}': [("user", "h"), ("assistant", "g")],
        '{"output":"o","instruction":"i"}': [("user", "i"), ("assistant", "o")],
        '{"id":7,"source":"s","prompt":"p","response":"r","meta":{"a":[1,{"b":2}]}}': [("user", "p"), ("assistant", "r")],
        '{"system":"s","prompt":"p","response":"r"}': [("system", "s"), ("user", "p"), ("assistant", "r")],
        '{"messages":[]}': [],
        '{"messages":[{"role":"user"},{"role":"assistant","content":"c","name":"n"}]}': [("user", ""), ("assistant", "c")],
        '{"prompt":"p","response":"r","messages":[{"role":"user","content":"u"}]}': None,
        '{"unknown":1}': None,
        "not json": None,
    }
    df = spark.createDataFrame([(r,) for r in rows] + [(None,)], "record string")
    got = {r["record"]: r["turns"] for r in chat.turns_of_json(df, "record").collect()}
    assert {k: v and [tuple(t) for t in v] for k, v in got.items() if k} == rows and got[None] is None


ROLES = [["user", "assistant"], ["system", "user", "assistant"], ["user"], ["user", "assistant", "user"], ["system", "user", "assistant", "user"], ["tool", "User"], ["assistant", "system"]]


def test_layouts_of_the_query(spark):
    """Conversations become records of five layouts, told apart by their own fingerprints, and come back as they were."""
    rows = [(c, k, role, f"{c} {role} {k}") for c, roles in enumerate(ROLES) for k, role in enumerate(roles)]
    records = chat.conversations_to_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.turns_of_struct(records, "record").collect()
    assert len({r["layout"] for r in got}) == 5
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in got} == {c: [(role, f"{c} {role} {k}") for k, role in enumerate(roles)] for c, roles in enumerate(ROLES)}
    whole = chat.format_conversations(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    assert whole.select("layout").distinct().count() >= 4 and whole.where("turns is null").count() == 0


def test_json_and_struct_agree(spark):
    rows = [(c, k, role, f"{c} {role}") for c, roles in enumerate(ROLES) for k, role in enumerate(roles)]
    records = chat.conversations_to_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    typed = {r["conv_id"]: (r["layout"], r["turns"]) for r in chat.turns_of_struct(records, "record").collect()}
    json = {r["conv_id"]: (r["layout"], r["turns"]) for r in chat.turns_of_json(records.select("conv_id", F.to_json("record").alias("j")), "j").collect()}
    assert typed == json


def test_very_long_and_null(spark):
    rows = [(1, 0, "user", "long <| & " * 300_000), (1, 1, "assistant", "b" * 2_000_000), (2, 0, None, None)]
    assert run(spark, rows) == digests(rows)


def test_field_paths(spark):
    df = spark.createDataFrame([], "r struct<b: array<struct<y:int,x:int>>, a: string>")
    assert chat.field_paths(df.schema["r"].dataType) == ["a", "b[].x", "b[].y"]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(x,) for x in NASTY], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and "<|" not in r["e"]


def test_query_has_no_python(spark, sf_dir):
    from gridloom.llm.queries import queries

    df = queries()["op10_chat"](spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert "Python" not in df._jdf.queryExecution().toString()
