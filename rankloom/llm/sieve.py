"""A sieve of ids: which rows can hold one of some ids, told without moving the rows.

A join of whole texts with a list of ids shuffles every text once the list is
too long to broadcast. The sieve is a Bloom filter of 64-bit words, each id
setting ``BITS`` bits of one word. It is built by a shuffle of (word, bits)
rows, about 2 bytes an id and at most ``MAX_WORDS`` words, whatever the input;
beyond about 8 million ids it lets more of the other rows pass. No row with one
of the ids is ever lost; of the others about one in 100 passes, so what
passes is to meet the ids themselves in a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix64

BITS, IDS_A_WORD, MAX_WORDS = 5, 4, 1 << 21


def _places(ids: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits in it) of each id."""
    h = mix64(ids.astype(np.int64).view(np.uint64))
    bits = np.zeros(len(h), np.uint64)
    for k in range(BITS):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(32)) % np.uint64(words)).astype(np.int64), bits


class Sieve:
    """Made on the driver; ``passes`` is for tasks."""

    def __init__(self, ids: DataFrame):
        """``ids`` has one column of long values; nulls and repeats don't matter."""
        name, = ids.columns
        ids = ids.where(F.col(name).isNotNull())
        size = self.size = int(min(MAX_WORDS, max(1, ids.count() // IDS_A_WORD)))

        def placed(batches):
            for b in batches:
                word, bits = _places(b.column(0).to_numpy(zero_copy_only=False), size)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

        found = ids.mapInArrow(placed, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        held = np.zeros(size, np.uint64)
        held[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.held = ids.sparkSession.sparkContext.broadcast(held)

    def passes(self, ids: pa.Array) -> pa.Array:
        """Whether each id can be one of the sieve's; a null can't."""
        word, bits = _places(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), self.size)
        return pc.and_(pa.array(self.held.value[word] & bits == bits), pc.is_valid(ids))

    def column(self, id_col: str) -> Column:
        """``passes`` as a column; only the ids go through Python."""
        passes = self.passes

        @F.arrow_udf("boolean")
        def can(ids: pa.Array) -> pa.Array:
            return passes(ids)
        return can(F.col(id_col).cast("long"))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` whose id is not in ``ids`` (its one column has the same name). Only the rows the sieve lets pass,
    nearly all of them to go, are joined; the others stay where they are read."""
    name, = ids.columns
    sieve = Sieve(ids)
    stays = F.coalesce(~sieve.column(name), F.lit(True))
    return rows.where(stays).unionByName(rows.where(sieve.column(name)).join(ids, name, "left_anti"))
