"""One query for each corpus operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitkit.llm import decontam, langid, lexical_search, licenses, line_quality, pii, quality, secret_scan, simhash, source_audit, token_shards, toxicity
from fitkit.llm import piece_lattice as lattice
from fitkit.llm.common import held_out, table


def model_file() -> str:
    """The vocabulary file of the queries; every operator takes its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs)
    found = langid.predict_languages(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "family")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    make = token_shards.byte_bpe(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    # 50256 is free in this vocabulary.
    return token_shards.materialise(table(spark, sf_dir, "documents"), make, end_id=50256, pad_id=50256)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.verdict(quality.POLICIES["base"])).alias("base_failed"),
        quality.verdict(quality.POLICIES["v1"]).alias("kept"),
        "failed",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.recognise(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licences", ",").alias("licences"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        "text",
        F.size("pii").cast("long").alias("n_pii"),
        F.array_join(
            F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        ).alias("spans"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("found").alias("hit")).select(
        "doc_id", F.col("hit.item").alias("item_id"), "hit.cosine", "hit.lcs", "hit.answer"
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    codec = lattice.Codec.fit(docs, model_file())
    return codec.encode(docs, packed=True, verify=True).select(
        "doc_id",
        F.when(F.col("ids").isNotNull(), F.octet_length("ids") / codec.item_bytes).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "restored",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        "predicted",
        F.size("segments").cast("long").alias("n_segments"),
    )


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return line_quality.score_quality(docs, model).select(
        "doc_id",
        (~line_quality.learning_part()).alias("held_out"),
        "score",
        "predicted",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["good"] < 0.5)).cast("long").alias("n_bad_lines"),
    )


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_language_id,
        op2_token_shards,
        op3_quality_rules,
        op4_license_scan,
        op5_pii,
        op6_decontamination,
        op7_secrets,
        op8_sentencepiece,
        op9_simhash,
        op10_toxicity,
        op11_quality_classifier,
        op12_source_audit,
        op13_lexical_search,
    ]
    return {f.__name__: f for f in made} | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
