"""Operator 10: token counts attributed to fields and sections by offsets.

The fields of a row are rendered as one text, which is encoded once. Token
byte lengths give every token's span, and the spans are joined to the section
borders by binary search (an interval join of two sorted lists). A token that
crosses a border is one token still; ``rule`` says which section gets it:
``first`` (the section of its first byte) or ``last`` (of its last byte). So
the sections' counts always add up to the count of the whole text.

Rows are encoded where they are scanned, without a shuffle. Offsets are code
points. Defined results: null fields count as empty; a row without any text
has its field sections with 0 tokens; repeated rows are counted each; a row of
any length is encoded whole; no rows give no rows; only the id and the named
fields are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _ship, read_ranks
from .common import slices, table

BREAK = 10  # a section of a field ends behind each line feed
SCHEMA = "field string, section int, start long, end long, n_tokens long, n_crossing long"

_TOKENIZERS: dict[tuple, tuple] = {}


def tokenizer(raw: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Encoding and the byte length of each id, once for each worker process."""
    key = (zlib.crc32(raw), len(raw), pattern)
    if key not in _TOKENIZERS:
        ranks = read_ranks(raw)
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, r in ranks.items():
            size[r] = len(token)
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size)
    return _TOKENIZERS[key]


def attribute(sizes: np.ndarray, borders: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that cross a border.

    ``sizes``: byte length of each token. ``borders``: start of each section,
    then the end of the text; sections cover it without gaps (empty ones allowed).
    """
    ends = np.cumsum(sizes)
    first = np.searchsorted(borders, ends - sizes, side="right") - 1
    last = np.searchsorted(borders, ends - 1, side="right") - 1
    owner = first if rule == "first" else last
    n = len(borders) - 1
    return np.bincount(owner, minlength=n), np.bincount(owner[first != last], minlength=n)


def count_tokens(docs: DataFrame, fields: list[str], path: str, pattern: str, id_col: str = "doc_id",
                 joint: str = "\n", rule: str = "first") -> DataFrame:
    """One row per section: id, field, section number, start, end, n_tokens, n_crossing.

    Fields are joined by ``joint``, which belongs to the field before it. The
    last field is cut into lines (sections); the others are one section each.
    """
    if rule not in ("first", "last"):
        raise ValueError(f"unknown rule {rule}")
    raw = _ship(docs.sparkSession, path)
    df = docs.select(id_col, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_f{k}") for k, f in enumerate(fields)])

    def run(batches):
        encoding, size = tokenizer(raw.value, pattern)
        for b in slices(batches, 64):
            keep, names, numbers, starts, stops, counts, crossing = [], [], [], [], [], [], []
            for row, parts in enumerate(zip(*[b.column(k + 1).to_pylist() for k in range(len(fields))])):
                text = joint.join(parts)
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                sizes = size[np.array(encoding.encode_ordinary(text), dtype=np.int64)]
                heads = [len((p + joint).encode()) for p in parts[:-1]]
                begin = sum(heads)
                lines = np.flatnonzero(data[begin:] == BREAK) + begin + 1
                lines = lines[lines < len(data)]
                borders = np.concatenate([[0], np.cumsum(heads, dtype=np.int64), lines, [len(data)]]).astype(np.int64)
                tokens, across = attribute(sizes, borders, rule)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[borders]
                n, h = len(borders) - 1, len(heads)
                keep += [row] * n
                names += [*fields[:-1], *[fields[-1]] * (n - h)]
                numbers += [*[0] * h, *range(n - h)]
                starts.append(points[:-1])
                stops.append(points[1:])
                counts.append(tokens)
                crossing.append(across)
            join = lambda a: pa.array(np.concatenate(a) if a else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), pa.array(names, pa.string()), pa.array(numbers, pa.int32()),
                 join(starts), join(stops), join(counts), join(crossing)],
                [id_col, "field", "section", "start", "end", "n_tokens", "n_crossing"])

    return df.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {SCHEMA}")


def op10_token_counts(spark, sf_dir):
    import public_tokenizers as known
    return count_tokens(table(spark, sf_dir, "documents"), ["source", "text"], known.path("byte_bpe_50k.tiktoken"),
                        known.PATTERN)
