"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from seqweave.llm import (
    collocations,
    embedding_join,
    exact_dedup,
    language,
    lexical_search,
    mixing,
    ngram_jaccard,
    oracles,
    packing,
    perplexity,
    quality_rules,
    sharding,
    url_filter,
    warc,
)
from seqweave.llm.common import table


def op1_url_filter(spark, folder):
    """Rules, and trust and distrust along links, for all pages."""
    return url_filter.judge(table(spark, folder, "pages"))


def op2_language_id(spark, folder):
    """Language of every document, learned from those that are not held out."""
    return language.identify(table(spark, folder, "documents"))


def op3_sharding(spark, folder):
    """Extendible-hashing shards of all documents."""
    return sharding.shards_of(table(spark, folder, "documents"))


def op4_source_mixing(spark, folder):
    """Balanced mix of all documents to the sources' targets."""
    return mixing.mix(table(spark, folder, "documents"))


def op5_quality_rules(spark, folder):
    """Measures of every document and the verdict of its weighed votes."""
    return quality_rules.judge(table(spark, folder, "documents"))


def op6_quality_classifier(spark, folder):
    """Perplexity of every document under the trusted documents' model."""
    return perplexity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_packing(spark, folder):
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"))


def op8_warc_revisits(spark, folder):
    """All pages written as archives without repeated payloads, and read back."""
    return warc.round_trip(table(spark, folder, "pages")).drop("target_uri")


def op9_embedding_join(spark, folder):
    """Links and components of all vectors at cosine 0.9."""
    return embedding_join.link_vectors(table(spark, folder, "embeddings"), cosine=0.9)


def op10_ngram_jaccard_join(spark, folder):
    """Components of all documents linked at Jaccard 0.8 on five-word shingles."""
    return ngram_jaccard.link_documents(table(spark, folder, "documents"), width=5, percent=80)


def op11_phrase_collocations(spark, folder):
    """Collocations of two and three words in all documents, 2000 a language."""
    return collocations.mine(table(spark, folder, "documents"))


def op12_lexical_search(spark, folder):
    """The ten best of all documents for every benchmark item."""
    return lexical_search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_exact_dedup(spark, folder):
    """Groups of equal texts among all documents."""
    return exact_dedup.judge(table(spark, folder, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_sharding": op3_sharding,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_embedding_join": op9_embedding_join,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.judge_sql(),
    "op3_sharding": sharding.shards_sql(),
    "op5_quality_rules": quality_rules.judge_sql(),
    "op8_warc_revisits": oracles.revisits_sql(),
    "op9_embedding_join": oracles.vectors_sql(),
    "op10_ngram_jaccard_join": oracles.jaccard_sql(),
    "op11_phrase_collocations": collocations.mine_sql(),
    "op12_lexical_search": lexical_search.rank_sql(),
    "op13_exact_dedup": exact_dedup.judge_sql(),
}
