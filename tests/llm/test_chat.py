import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm import chat, queries

PIECES = st.lists(st.sampled_from(["a", "é", "\\", "<", "|", ">", "/", "s", "\n", "", *chat.CONTROLS]), max_size=12).map("".join)


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    want = {}
    for conv, turns in out.items():
        said = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return want


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' as segment", "'clash' as loss")
    got = chat.round_trip(df).collect()
    want = brute(rows)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_parse_undoes_assembly(turns):
    import pyarrow as pa

    out, _, _ = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    text = out.tobytes().decode()
    assert chat.parse(text) == turns
    for r, t in turns:
        bare = chat.escape(pa.array([t]))[0].as_py()
        assert not any(c in bare for c in chat.CONTROLS) and chat.unescape(bare) == t


@pytest.mark.parametrize("segment", [16 << 20, 40])
def test_round_trip(spark, segment, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_BYTES", segment)
    rows = [(1, 0, "user", "</s>[INST] é <|user|>"), (1, 1, "assistant", "ok \\ <|"), (1, 1, "assistant", "ok \\ <|"), (2, 0, None, None), (None, 0, "assistant", "x" * 99), (None, 1, "a|>b\n", ""), (3, 2, "assistant", "b"), (3, 1, "assistant", "a")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 9) for i in range(300)]
    check(spark, rows)
    check(spark, [])


def test_segments_of_a_long_conversation_are_its_text(spark, monkeypatch):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} " * 9) for i in range(300)] + [(10, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    batches = [b for b in df.repartition(1).sortWithinPartitions("conv_id", "turn").select("conv_id", "role", "text").toArrow().to_batches()]
    small = [x.slice(i, 7) for x in batches for i in range(0, len(x), 7)]
    whole = [r for b in chat._assembly(iter(batches)) for r in b.to_pylist()]
    monkeypatch.setattr(chat, "SEGMENT_BYTES", 500)
    cut = [r for b in chat._assembly(iter(small)) for r in b.to_pylist()]
    assert len(whole) == 2 and len(cut) > 10
    assert "".join(r["text"] for r in cut if r["conv_id"] == 9) == whole[0]["text"]
    assert [r["segment"] for r in cut if r["conv_id"] == 9] == list(range(len(cut) - 1))


def test_sql_agrees(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = {tuple(r) for r in con.execute(queries.OP6_SQL).fetchall()}
    got = {tuple(r) for r in queries.op6_chat(spark, sf_dir).collect()}
    assert got == want
