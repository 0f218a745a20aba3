"""Operator 1: chat formatting by columnar byte assembly.

A turn becomes ``### Role: text</turn>\\n``. Control strings inside a text get
an escape character, so the output can be read back exactly. Within an Arrow
batch no string is joined in Python: segment lengths, cumulative offsets and
one scatter index are computed in numpy and the bytes of headers, texts and
end marks are gathered into one preallocated buffer.

A conversation may be any size. Rows are range-partitioned by
(conversation, turn), so one that holds a third of all rows is formatted by
many tasks; it comes out as several ordered parts, each of at most
``PART_BYTES`` plus one turn. The reader streams parts in order with running
digests and never holds a conversation.

Defined results: null text is empty; a null role is written as an empty one;
rows of one conversation with equal turns are ordered by role, then text
(repeated rows stay); a null conversation id is a conversation of its own;
no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, slices, table

HEAD, SEP, END, ESC = "### ", ": ", "</turn>\n", "\\"
ROLES = {"user": "User", "assistant": "Assistant", "system": "System"}
NAMES = {v: k for k, v in ROLES.items()}
CONTROL = r"(\\|###|</turn>)"
PART_BYTES = 4 << 20

PARTS_SCHEMA = ("conv_id long, part_turn long, part_no long, n_turns long, formatted string, "
                "loss_starts array<int>, loss_ends array<int>")
DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long")

_SCAN = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")


def header(role: str | None) -> str:
    """Turn header. Names outside the known ones carry an @ and escape the separator."""
    role = role or ""
    name = ROLES.get(role) or "@" + role.replace(ESC, ESC * 2).replace(":", ESC + ":")
    return HEAD + name + SEP


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if ESC in text else text


def _escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, CONTROL, r"\\\1")


def assemble_rows(roles: list, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns of a batch in one buffer.

    Returns (buffer, row offsets, start and end of each row's text inside the buffer).
    """
    n = len(roles)
    body = _escape(pc.fill_null(texts.cast(pa.large_string()), ""))
    text_off = np.frombuffer(body.buffers()[1], dtype=np.int64)[body.offset:body.offset + n + 1]
    data = body.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    kinds = {r: k for k, r in enumerate(dict.fromkeys(roles))}
    heads = [header(r).encode() for r in kinds]
    small = b"".join(heads) + END.encode()
    pool = np.concatenate([data, np.frombuffer(small, dtype=np.uint8)])
    head_len = np.array([len(h) for h in heads], dtype=np.int64)
    head_at = len(data) + np.concatenate([[0], np.cumsum(head_len)[:-1]]).astype(np.int64)
    kind = np.array([kinds[r] for r in roles], dtype=np.int64)
    starts = np.empty((n, 3), dtype=np.int64)
    lens = np.empty((n, 3), dtype=np.int64)
    starts[:, 0], lens[:, 0] = head_at[kind], head_len[kind]
    starts[:, 1], lens[:, 1] = text_off[:-1], np.diff(text_off)
    starts[:, 2], lens[:, 2] = len(pool) - len(END), len(END)
    out, offsets = gather(pool, starts.ravel(), lens.ravel())
    return out, offsets[::3], offsets[1::3], offsets[2::3]


def _assemble(batches):
    """Rows sorted by (conv_id, turn) to parts; a part ends with its conversation or at PART_BYTES."""
    held, open_conv, open_turn, part = [], None, None, 0
    size = 0

    def flush():
        formatted = b"".join(h[0].tobytes() for h in held)
        spans, base = [], 0
        for buf, _, loss in held:
            spans += [(a + base, b + base) for a, b in loss]
            base += len(buf)
        return (open_conv, open_turn, part, sum(h[1] for h in held), formatted.decode("utf-8"),
                [a for a, _ in spans], [b for _, b in spans])

    def batch_of(rows):
        cols = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["conv_id", "part_turn", "part_no", "n_turns", "formatted", "loss_starts", "loss_ends"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    for batch in slices(batches, 2048):
        if not batch.num_rows:
            continue
        rows, rows_size = [], 0
        convs, turns = batch.column("conv_id").to_pylist(), batch.column("turn").to_pylist()
        roles = batch.column("role").to_pylist()
        buf, offs, a, b = assemble_rows(roles, batch.column("text"))
        at = 0
        while at < len(convs):
            if held and (convs[at] != open_conv or size >= PART_BYTES):
                rows.append(flush())
                rows_size += size
                part = part + 1 if convs[at] == open_conv else 0
                held, size = [], 0
            if not held:
                part = part if convs[at] == open_conv else 0
                open_conv, open_turn = convs[at], turns[at]
            end = at
            while end < len(convs) and convs[end] == open_conv and size + offs[end] - offs[at] < PART_BYTES:
                end += 1
            end = max(end, at + 1)
            loss = [(int(a[k] - offs[at]), int(b[k] - offs[at])) for k in range(at, end) if roles[k] == "assistant"]
            held.append((buf[offs[at]:offs[end]].copy(), end - at, loss))
            size += int(offs[end] - offs[at])
            at = end
            if rows_size > 4 * PART_BYTES:
                yield batch_of(rows)
                rows, rows_size = [], 0
        if rows:
            yield batch_of(rows)
    if held:
        yield batch_of([flush()])


def format_chats(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ordered parts of every conversation with their loss spans (byte offsets in ``formatted``).

    Parts of one conversation are ordered by (partition of the range, part_no).
    """
    n = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role"]  # texts stay out of the range sample the driver takes
    df = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                      F.col("text").cast("string"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text")
    parts = ranged.mapInArrow(_assemble, PARTS_SCHEMA)
    return parts.withColumn("part_range", F.spark_partition_id())


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    out, at = [], 0
    while at < len(formatted):
        stop = at + len(HEAD)
        if formatted[stop:stop + 1] == "@":
            m = re.compile(r"((?:[^\\:]|\\.)*): ", re.S).match(formatted, stop + 1)
            role, begin = re.sub(r"\\(.)", r"\1", m[1], flags=re.S), m.end()
        else:
            colon = formatted.index(SEP, stop)
            role, begin = NAMES[formatted[stop:colon]], colon + len(SEP)
        for m in _SCAN.finditer(formatted, begin):
            if m[0] == END:
                break
        out.append((role, unescape(formatted[begin:m.start()])))
        at = m.end()
    return out


def _read_back(batches):
    """Digests of each conversation from its parts, which arrive in order; only hash states are kept."""
    state, conv, rows = None, None, []

    def done():
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def batch_of(rows):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in slices(batches, 64):
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != conv:
                if state is not None:
                    rows.append(done())
                conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse(r["formatted"])
            state[0] += len(turns)
            for role, text in turns:
                state[1].update(f"{role}\n{text}\n".encode())
            raw = r["formatted"].encode()
            for a, b in zip(r["loss_starts"], r["loss_ends"]):
                text = unescape(raw[a:b].decode())
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(r["formatted"])
        if len(rows) >= 1024:
            yield batch_of(rows)
            rows = []
    if state is not None:
        rows.append(done())
    if rows:
        yield batch_of(rows)


def read_back(parts: DataFrame) -> DataFrame:
    """Digest row per conversation, computed only from the formatted output and its loss mask."""
    order = ["conv_id", "part_range", "part_no"]
    return (parts.repartition("conv_id").sortWithinPartitions(*order)
                 .select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(_read_back, DIGEST_SCHEMA))


PROBE = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_chats(turns.unionByName(probe)))


def oracle() -> str:
    known = " ".join(f"WHEN '{k}' THEN {len(v)}" for k, v in ROLES.items())
    fixed = len(HEAD) + len(SEP) + len(END)
    probe = PROBE.replace("'", "''")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{probe}' UNION ALL SELECT -7, 1, 'assistant', '{probe}'),
e AS (SELECT *, {fixed} + CASE role {known}
        ELSE 1 + length(role) + length(role) - length(replace(replace(role, '\\', ''), ':', '')) END
        + length(regexp_replace(text, '{CONTROL}', '\\\\\\1', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
