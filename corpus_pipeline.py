"""The corpus pipeline: documents through five stages, each one operator of the llm subpackage.

Every stage works on all rows its predecessor kept and returns the columns of documents, the last one the encoded corpus.
SQL cannot express the stages; tests hold them against brute-force versions.
"""

from __future__ import annotations

from quarry.llm import decontaminate, jaccard_join, sentencepiece_lattice, suffix_dedup, toxicity
from quarry.llm.common import stored, table
from quarry.llm.queries import tokenizer_file


def drop_toxic(spark, docs, sf_dir):
    """Drops the documents that the field, learned from the labels and these documents, scores 0.5 or more."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps the document of the smallest doc_id of each class at five words and a Jaccard similarity of 0.8.

    Documents without words, and rows with null doc_id, have no links and stay.
    """
    classes = jaccard_join.jaccard_components(docs, k=5, num=80, den=100)
    return docs.join(classes.where("component_id <> doc_id").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark, docs, sf_dir):
    """Removes every byte that an earlier copy of the same 100-byte string covers; documents stay, even if nothing is left."""
    return suffix_dedup.rewritten(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Drops the documents that hold a benchmark passage."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """(doc_id, n_pieces, ids, text): SentencePiece ids, and the text decoded from them."""
    path = tokenizer_file("piece_bpe_32k.model")
    back = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, path), path)
    return back.selectExpr("doc_id", "cast(size(ids) as bigint) AS n_pieces", "ids", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
