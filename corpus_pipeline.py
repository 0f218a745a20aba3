"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``documents``:

1. toxicity: documents the labelled examples' neighbours call toxic go.
2. near_duplicates: of each group of near copies (Jaccard 0.8 on five-word
   shingles) the document with the smallest id stays.
3. personal_data: spans are replaced by ``<KIND>`` marks.
4. mixing: documents are left out or repeated until sources meet their targets.
5. token_ids: byte-level BPE ids of each text, and the digest of what they decode to.

An empty table passes through every stage; null texts are kept and get no ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.llm import bpe, minhash, mixing, pii, toxicity
from rankloom.llm.common import materialise, prepare, table, word_count


def drop_toxic(spark, docs, sf_dir):
    model, counted = toxicity.fit_counted(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(counted, model)


def drop_near_duplicates(spark, docs, sf_dir):
    prepare(spark)
    return minhash.drop_near_duplicates(docs, 80)


def redact_personal_data(spark, docs, sf_dir):
    prepare(spark)
    return pii.redact_pii(docs, "text", "n_chars")


def mix_sources(spark, docs, sf_dir):
    prepare(spark)
    return mixing.mixed(docs, F.array("source"), word_count(F.col("text")))


def encode(spark, docs, sf_dir):
    import public_tokenizers as known
    prepare(spark)
    return bpe.round_trip(docs, known.path("byte_bpe_multi_50k.tiktoken"), known.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", redact_personal_data),
          ("mixing", mix_sources), ("token_ids", encode)]

# Neighbour votes, set similarity, checksums and byte-pair encoding are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
