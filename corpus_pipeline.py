"""The corpus pipeline: language, line dedup, near dedup, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers

from sablewatch.llm import language, lines, near, packing, pii
from sablewatch.llm.base import table
from sablewatch.llm.queries import PII_KEY
from sablewatch.session import materialised

#: SQL cannot express learnt languages, samples or packing; tests compare with brute force.
ORACLE_SQL = None


def known_language(spark, docs, sf_dir):
    """Documents without a letter, or in none of the learnt languages, go."""
    return language.stage(docs)


def without_frequent_lines(spark, docs, sf_dir):
    """Lines found in ten documents or more go; a document stays even if all its lines go."""
    return lines.stage(docs)


def one_of_each_group(spark, docs, sf_dir):
    """Of near duplicates the document with the least doc_id stays."""
    return near.stage(docs)


def pseudonyms(spark, docs, sf_dir):
    return pii.stage(docs, PII_KEY)


def packed(spark, docs, sf_dir):
    """Places of all documents' tokens in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_frequent_lines),
    ("near_dedup", one_of_each_group),
    ("pii", pseudonyms),
    ("packing", packed),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialised(docs, f"pipeline-{name}")
    return docs
