import numpy as np
import public_tokenizers as P
import tiktoken

from rankloom.llm import bpe, tokens

PATH = P.path("byte_bpe_50k.tiktoken")


def brute(encoding, fields, rule):
    text = "\n".join(f or "" for f in fields)
    raw = text.encode()
    starts, at = [0], 0
    for f in fields[:-1]:
        at += len((f or "").encode()) + 1
        starts.append(at)
    starts += [k + 1 for k in range(at, len(raw)) if raw[k] == 10 and k + 1 < len(raw)]
    counts, cross, pos = [0] * len(starts), [0] * len(starts), 0
    owner = lambda byte: max(k for k, s in enumerate(starts) if s <= byte)
    for t in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(t))
        a, b = owner(pos), owner(pos + size - 1)
        counts[a if rule == "first" else b] += 1
        cross[a if rule == "first" else b] += a != b
        pos += size
    return counts, cross


def test_as_token_by_token(spark):
    with open(PATH, "rb") as f:
        encoding = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    rows = [(1, "src", "one\n\n\n  two é\nthree"), (2, None, None), (3, "a\nb", "\n\nx\n"), (4, "", "日本語\n" * 50), (4, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for rule in ("first", "last"):
        got: dict = {}
        for r in tokens.count_tokens(df, ["source", "text"], PATH, P.PATTERN, rule=rule).collect():
            got.setdefault(r.doc_id, []).append((r.field == "text", r.section, r.start, r.end, r.n_tokens, r.n_crossing))
        for i, *fields in rows[:3]:
            counts, cross = brute(encoding, fields, rule)
            assert [(g[4], g[5]) for g in sorted(got[i])] == list(zip(counts, cross)), (i, rule)
            assert sorted(got[i])[-1][3] == len("\n".join(f or "" for f in fields))
        assert len(got[4]) == 51 + 2


def test_attribution_of_crossing_tokens():
    first, crossing = tokens.attribute(np.array([2, 3, 1]), np.array([0, 3, 3, 6]))
    assert first.tolist() == [2, 0, 1] and crossing.tolist() == [1, 0, 0]
    last, _ = tokens.attribute(np.array([2, 3, 1]), np.array([0, 3, 3, 6]), "last")
    assert last.tolist() == [1, 0, 2]


def test_odd_rows(odd_docs, no_docs):
    assert tokens.count_tokens(odd_docs, ["source", "text"], PATH, P.PATTERN).select("doc_id").distinct().count() == 11
    assert tokens.count_tokens(no_docs, ["source", "text"], PATH, P.PATTERN).count() == 0
