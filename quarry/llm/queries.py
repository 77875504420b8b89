"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from .centroid_clusters import oracle as clusters_sql
from .common import table
from .mtree import SQL as TOP_K_SQL


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark, sf_dir):
    """Ids of every text, and the digest of their decoding: the text itself, with U+2581 read as a space."""
    from pyspark.sql import functions as F

    from . import sentencepiece_lattice as S

    path = tokenizer_file("piece_bpe_32k.model")
    back = S.decode(S.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op8_ngram_jaccard_join(spark, sf_dir):
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_suffix_array_dedup(spark, sf_dir):
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_html_extraction(spark, sf_dir):
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_language_id(spark, sf_dir):
    from . import language_id

    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op6_exact_top_k(spark, sf_dir):
    from .mtree import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_benchmark_decontamination(spark, sf_dir):
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark, sf_dir):
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_token_output(spark, sf_dir):
    from .repair_output import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end=2))


def op10_warc(spark, sf_dir):
    from .warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_approximate_neighbours(spark, sf_dir):
    from .vptree import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark, sf_dir):
    from . import periodic_runs as P

    return P.digests(P.periodic_runs(table(spark, sf_dir, "documents"), prepare=P.planted))


def op13_centroid_clustering(spark, sf_dir):
    from .centroid_clusters import clusters

    return clusters(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_suffix_array_dedup, op3_html_extraction, op4_language_id, op5_benchmark_decontamination, op6_exact_top_k, op7_toxicity, op8_ngram_jaccard_join, op9_token_output, op10_warc, op11_approximate_neighbours, op12_periodic_runs, op13_centroid_clustering)
}
SQL: dict[str, str] = {
    "op6_exact_top_k": TOP_K_SQL,
    "op13_centroid_clustering": clusters_sql(),
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
             r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN response END AS refers_to
        FROM r""",
}
