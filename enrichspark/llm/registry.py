"""Queries of the corpus operators over the given tables, and their SQL twins."""

from __future__ import annotations

import corpus_pipeline
from enrichspark.llm import chat, decontaminate, embeddings, language, packing, periodic, quality, repair, sharding, simhash, tokens, toxicity, warc
from enrichspark.llm.common import table

QUERIES = {
    "op1_warc": lambda spark, d: warc.op1_warc(table(spark, d, "pages")),
    "op2_chat_formatting": lambda spark, d: chat.op2_chat_formatting(table(spark, d, "conversations")),
    "op3_best_fit_packing": lambda spark, d: packing.op3_best_fit_packing(table(spark, d, "documents")),
    "op4_language_id": lambda spark, d: language.op4_language_id(table(spark, d, "documents")),
    "op5_embedding_near_dedup": lambda spark, d: embeddings.op5_embedding_near_dedup(table(spark, d, "embeddings")),
    "op6_quality_classifier": lambda spark, d: quality.op6_quality_classifier(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_simhash_near_dedup": lambda spark, d: simhash.op7_simhash_near_dedup(table(spark, d, "documents")),
    "op8_sharding": lambda spark, d: sharding.op8_sharding(table(spark, d, "documents")),
    "op9_toxicity": lambda spark, d: toxicity.op9_toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op10_benchmark_decontamination": lambda spark, d: decontaminate.op10_benchmark_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op11_token_counts": lambda spark, d: tokens.op11_token_counts(table(spark, d, "documents")),
    "op12_periodic_runs": lambda spark, d: periodic.op12_periodic_runs(table(spark, d, "documents")),
    "op13_conversation_repair": lambda spark, d: repair.op13_conversation_repair(table(spark, d, "conversations")),
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_chat_formatting": chat.OP2_SQL,
    "op5_embedding_near_dedup": embeddings.OP5_SQL,
    "op8_sharding": sharding.OP8_SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
