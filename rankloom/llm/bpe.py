"""Operator 7: byte-level BPE by prefix dynamic programming.

The encoding of any prefix ends in exactly one token. ``Prefix`` stores that
last token for each byte prefix: a token that ends at a position is the one
when it forms a valid pair with the last token of the prefix before it. Since
an entry depends on earlier bytes only, appending extends the table and an
edit recomputes it from the edit on; nothing before changes. Short pieces share
one table (``Vocabulary.prefixes``), since words of a text share prefixes.

A pair is valid when no merge crosses its border. Only the tokens along the
right edge of the first one's merge tree and the left edge of the second's
ever touch the border, so a few rank look-ups decide it.

The vocabulary file is a parameter, read by the driver and broadcast (its size
is that of the vocabulary, not of the data). Texts are encoded where they are
scanned, without a shuffle; a bounded memo keeps repeated pieces.

Defined results: null and empty texts give no ids; repeated rows are encoded
each; no rows give no rows; only the id and text columns are read.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, slices, table

MEMO = 200_000
MEMO_BYTES = 64
_ENDLESS = 1 << 62


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the text of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Vocabulary:
    """Ranks with what pair checks need: the merge each token comes from and its two edges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.sizes = {r: len(b) for b, r in ranks.items()}
        self.prefixes: dict[bytes, int] = {}
        self.endings: dict = {}  # tokens by their bytes from the last to the first; -1 holds the rank
        for token, r in ranks.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = r
        self.edges: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}

    def parts(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        rank = self.ranks[token]
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if a < rank and b < rank and not self.crossed(a, b, rank):
                return token[:k], token[k:]
        return None

    def edge(self, t: int) -> tuple[list, list]:
        """Tokens along the left and the right edge, each with the rank of the merge that absorbs it."""
        if t not in self.edges:
            sides = []
            for side in (0, 1):
                out, token, until = [], self.tokens[t], _ENDLESS
                while token is not None:
                    out.append((token, until))
                    until, split = self.ranks[token], self.parts(token)
                    token = split[side] if split else None
                sides.append(out)
            self.edges[t] = tuple(sides)
        return self.edges[t]

    def crossed(self, a: int, b: int, below: int = _ENDLESS) -> bool:
        """Whether some merge of a rank under ``below`` crosses the border of ``a`` and ``b``."""
        get = self.ranks.get
        for x, until_x in self.edge(a)[1]:
            for y, until_y in self.edge(b)[0]:
                # at equal ranks the merge further left comes first
                if get(x + y, _ENDLESS) < min(until_x, until_y + 1, below):
                    return True
        return False

    def valid(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is how their joined bytes are encoded."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * MEMO:
                self.pairs.clear()
            known = self.pairs[key] = not self.crossed(a, b)
        return known

    def fill(self, data: bytes, last: list, done: int) -> None:
        """Complete ``last`` (last token of each prefix length) from prefix length ``done`` on."""
        endings, pairs, valid = self.endings, self.pairs, self.valid
        for end in range(done + 1, len(data) + 1):
            node, begin, found = endings, end, []
            while begin:  # tokens that end here, found from their last byte back
                begin -= 1
                node = node.get(data[begin])
                if node is None:
                    break
                t = node.get(-1)
                if t is not None:
                    found.append((begin, t))
            for begin, t in reversed(found):
                if not begin:
                    last[end] = t
                    break
                known = pairs.get(last[begin] << 32 | t)
                if valid(last[begin], t) if known is None else known:
                    last[end] = t
                    break

    def last(self, data: bytes) -> int:
        """The last token of ``data``, from the shared table; only the prefixes it depends on are completed."""
        t = self.prefixes.get(data)
        if t is not None:
            return t
        node, begin, found = self.endings, len(data), []
        while begin:
            begin -= 1
            node = node.get(data[begin])
            if node is None:
                break
            t = node.get(-1)
            if t is not None:
                found.append((begin, t))
        pairs = self.pairs
        for begin, t in reversed(found):
            if not begin:
                break
            before = self.last(data[:begin])
            known = pairs.get(before << 32 | t)
            if self.valid(before, t) if known is None else known:
                break
        self.prefixes[data] = t
        return t

    def encode(self, data: bytes) -> tuple[int, ...]:
        t = self.ranks.get(data)
        if t is not None:
            return (t,)
        if len(data) > MEMO_BYTES:
            return Prefix(self, data).ids()
        if len(self.prefixes) > MEMO:
            self.prefixes.clear()
        out = []
        while data:
            t = self.last(data)
            out.append(t)
            data = data[:-self.sizes[t]]
        return tuple(out[::-1])


class Prefix:
    """The table of one piece; stays exact under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [None]
        self.append(data)

    def append(self, more: bytes) -> None:
        done = len(self.data)
        self.data += more
        self.last += [None] * len(more)
        self.vocabulary.fill(self.data, self.last, done)

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Replace ``removed`` bytes at ``at``; prefixes up to ``at`` keep their entries."""
        rest = inserted + self.data[at + removed:]
        self.data, self.last = self.data[:at], self.last[:at + 1]
        self.append(rest)

    def ids(self) -> tuple[int, ...]:
        out, end = [], len(self.data)
        while end:
            t = self.last[end]
            out.append(t)
            end -= self.vocabulary.sizes[t]
        return tuple(reversed(out))


class Encoder:
    """Texts to ids: pieces of the pattern, each encoded by its prefix table or from the memo."""

    def __init__(self, raw: bytes, pattern: str):
        self.vocabulary = Vocabulary(read_ranks(raw))
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        ids = self.vocabulary.encode(data)
        if len(data) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def __call__(self, text: str) -> list[int]:
        known, piece = self.memo.get, self.piece
        return list(chain.from_iterable([known(p) or piece(p) for p in self.split(text)]))


def _ship(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoding(raw, pattern: str, id_col: str):
    def run(batches):
        encode = Encoder(raw.value, pattern)  # of this task alone, so an idle worker holds no memo
        for b in slices(batches, 128, text=1):
            rows = [encode(t) if t else [] for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(rows) + 1, dtype=np.int32)
            np.cumsum([len(r) for r in rows], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])
    return run


def _decoding(raw, id_col: str):
    def run(batches):
        ranks = read_ranks(raw.value)
        tokens = sorted(ranks, key=ranks.get)
        pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        size[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        del ranks, tokens
        for b in slices(batches, 128):
            ids = b.column(1)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, at = gather(pool, begin[flat], size[flat])
            out = pa.Array.from_buffers(pa.large_binary(), len(ids), [
                None, pa.py_buffer(np.ascontiguousarray(at[ends])), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, out], [id_col, "ids", "decoded"])
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    df = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    return df, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>"


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of int) of every row."""
    df, schema = _texts(docs, id_col, text_col)
    return df.mapInArrow(_encoding(_ship(docs.sparkSession, path), pattern, id_col), schema)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, ids and ``decoded`` (binary) of every row of ``encode_texts``."""
    df = encoded.select(id_col, "ids")
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary"
    return df.mapInArrow(_decoding(_ship(encoded.sparkSession, path), id_col), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids and ``decoded`` of every row: both steps in one pass, so one worker for each task."""
    raw = _ship(docs.sparkSession, path)
    df, schema = _texts(docs, id_col, text_col)
    encode, decode = _encoding(raw, pattern, id_col), _decoding(raw, id_col)
    return df.mapInArrow(lambda batches: decode(encode(batches)), schema + ", decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids again, and give both digests for each document."""
    return round_trip(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark, sf_dir):
    import public_tokenizers as known
    return digests(table(spark, sf_dir, "documents"), known.path("byte_bpe_multi_50k.tiktoken"), known.PATTERN)
