import random

import public_tokenizers as P
import pytest
import tiktoken

from rankloom.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        raw = f.read()
    mine = bpe.Encoder(raw, P.PATTERN)
    return mine, tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(raw), special_tokens={})


def some_texts(n):
    rnd = random.Random(4)
    kinds = ["ab", "thean ", "éèêç", "   \n\t", "0123", "!#$?", "日本語", "\U0001f642a", "aaaa", "\x00\x7f"]
    return ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_same_ids_as_the_library(both):
    mine, theirs = both
    for text in [*some_texts(4000), "a" * 3000, " " * 2000, "the" * 500, "<|endoftext|>"]:
        assert mine(text) == theirs.encode_ordinary(text)


def test_every_token_has_a_merge(both):
    v = both[0].vocabulary
    assert all(len(t) == 1 or v.parts(t) for t in v.ranks)


def test_appends_and_edits_stay_exact(both):
    v, rnd = both[0].vocabulary, random.Random(9)
    for _ in range(200):
        table = bpe.Prefix(v)
        for _ in range(6):
            if rnd.random() < 0.5 or not table.data:
                table.append(rnd.choice([b"the", b"tion", b"\xc3\xa9", b"ing an", b"zz"]))
            else:
                at = rnd.randrange(len(table.data))
                table.edit(at, rnd.randint(0, 3), rnd.choice([b"", b"e", b"re"]))
            assert table.ids() == bpe.Prefix(v, table.data).ids()
        assert b"".join(v.tokens[t] for t in table.ids()) == table.data


def test_full_memo_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    with open(PATH, "rb") as f:
        small = bpe.Encoder(f.read(), P.PATTERN)
    assert [small(t) for t in some_texts(200)] == [both[0](t) for t in some_texts(200)]


def test_round_trip_of_odd_rows(both, odd_docs, no_docs):
    out = bpe.decode_ids(bpe.encode_texts(odd_docs, PATH, P.PATTERN), PATH).collect()
    texts = {(r.doc_id, r.text or "") for r in odd_docs.collect()}
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in out} == texts and len(out) == odd_docs.count()
    assert all(r.ids == both[1].encode_ordinary(bytes(r.decoded).decode()) for r in out)
    assert bpe.digests(no_docs, PATH, P.PATTERN).count() == 0
