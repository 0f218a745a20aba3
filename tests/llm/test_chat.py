import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import chat

PIECES = st.lists(st.sampled_from(["\\", "###", "#", "</turn>", "</turn>\n", "### Assistant: ", ":", "a", "é", "\n", "<", "@"]),
                  max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=4))
def test_any_turns_read_back(turns):
    import pyarrow as pa
    buf, *_ = chat.assemble_rows([r for r, _ in turns], pa.array([t for _, t in turns], pa.string()))
    assert chat.parse(buf.tobytes().decode()) == turns


def test_digests_and_odd_rows(spark):
    rows = [(1, 0, "user", "hi \\### Assistant: </turn> ok"), (1, 1, "assistant", "é" * 3), (1, 2, "assistant", None),
            (1, 1, "assistant", "é" * 3), (None, None, None, "x"), (2, 0, "tool:\\", ""), (3, 5, "assistant", "y" * 200_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, 3)).collect()}
    assert set(got) == {1, 2, 3, None}
    one = sorted((r[1:] for r in rows if r[0] == 1), key=lambda r: (r[0], r[1], r[2] or ""))
    assert got[1].n_turns == 4 and got[1].loss_chars == 6
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for _, r, t in one).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(("é" * 6).encode()).hexdigest()
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()
    assert got[3].loss_chars == 200_000
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_a_hot_conversation_comes_in_parts(spark, monkeypatch):
    rows = [(7, k, "user" if k % 2 else "assistant", f"turn {k} " * 20) for k in range(3000)]
    rows += [(100 + k, 0, "user", "short") for k in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    parts = chat.format_chats(df, 6)
    hot = parts.where("conv_id = 7")
    assert hot.select("part_range").distinct().count() > 1
    got = chat.read_back(parts).where("conv_id = 7").first()
    assert got.n_turns == 3000
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:3000]).encode()).hexdigest()


def test_parts_end_at_their_size():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"conv_id": [1] * 30, "turn": list(range(30)), "role": ["assistant"] * 30,
                                        "text": ["t" * 1_000_000] * 30})
    out = pa.Table.from_batches(list(chat._assemble(iter([batch]))))
    assert out.column("part_no").to_pylist() == list(range(out.num_rows)) and out.num_rows > 5
    assert sum(out.column("n_turns").to_pylist()) == 30
