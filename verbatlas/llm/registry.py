"""The queries of this package and their SQL, for the entry file."""

from verbatlas.llm import ann, bpe, chat, compaction, divergence, language_id, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, warc

MODULES = (bpe, ngram_join, ann, sharding, chat, warc, mixing, quality_rules, language_id, quality_classifier, packing, divergence, compaction)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
