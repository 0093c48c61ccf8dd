"""A training corpus from raw documents: toxic documents go, repeated lines go, one document of each
group of near copies stays, documents contaminated by the benchmark go, the rest is encoded.

Every stage is written as Parquet in the shared folder and reread, so a lost executor costs at most
the work of one stage.
"""

from __future__ import annotations

from rollbook.llm import bpe_codec, decontaminate, lines, simhash, toxicity
from rollbook.llm.common import settle, table
from rollbook.llm.queries import tokenizer_path

#: Word shingles of the near-duplicate stage.
WORDS = 5


def drop_toxic(spark, docs, sf_dir):
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark, docs, sf_dir):
    return lines.dedup_lines(docs)


def near_dedup(spark, docs, sf_dir):
    return simhash.keep_one_copy(docs, words=WORDS)


def decontaminated(spark, docs, sf_dir):
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark, docs, sf_dir):
    return bpe_codec.digests(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash", near_dedup),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: Classifiers, restored text, MinHash and tokenizers are beyond SQL; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
