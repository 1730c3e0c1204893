"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bestfit,
    bwtdedup,
    chat,
    classlm,
    hardneg,
    mixture,
    periodic,
    pii,
    quality,
    secrets,
    simhash,
    toxicity,
    winnow,
)
from .common import read_table, split_words
from .oracles import ORACLE_QUERIES  # noqa: F401

VOCABULARY = "word_bpe_49k.json"
ESCAPE_TEST = f"{chat.END}{chat.START}assistant ok"


def tokenizer_path() -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(read_table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["kind"].isin([r.kind for r in secrets.BASE_RULES]))

    def count(kind: str) -> F.Column:
        n = F.size(F.filter("findings", lambda x: x["kind"] == kind))
        return F.when(F.col("findings").isNull(), 0).otherwise(n).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(r.kind) for r in secrets.BASE_RULES),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("findings")).alias("spans"),
    )


def op4_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.class_model_scores(read_table(spark, sf_dir, "documents"))


def op5_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(-1, 0, "user", ESCAPE_TEST), (-1, 1, "assistant", ESCAPE_TEST)]
    more = spark.createDataFrame(hard, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best_fit(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwtdedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.pack_mixture(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_components(read_table(spark, sf_dir, "documents"))
    hex_digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near.select("doc_id", hex_digits.alias("fingerprint"), "component_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", moved))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.fit(docs))

    def lines(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(list(pii.KINDS)))
    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.KINDS),
        F.sha2(lines(base), 256).alias("base_sha256"),
        lines(F.col("spans")).alias("spans"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", split_words(F.col("text")).alias("words"), F.crc32(F.col("doc_id").cast("string")).alias("h")
    )
    # In a tenth of the texts the words from `a` on repeat with the period `p`.
    docs = docs.withColumn("n", F.size("words")).withColumn("g", F.expr("h DIV 10"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) DIV (3 + g % 8) AS int)"))
    repeated = F.expr("transform(words, (w, i) -> if(i < a, w, get(words, a + (i - a) % p)))")
    words = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), repeated).otherwise(F.col("words"))
    found = periodic.periodic_runs(docs, words=words)
    best = F.expr(
        "get(array_sort(runs, (x, y) -> CASE "
        "WHEN x.length <> y.length THEN if(x.length > y.length, -1, 1) "
        "WHEN x.start <> y.start THEN if(x.start < y.start, -1, 1) "
        "ELSE cast(signum(x.period - y.period) AS int) END), 0)"
    )
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_secret_scans": op3_secret_scans,
    "op4_class_ngrams": op4_class_ngrams,
    "op5_chat_round_trip": op5_chat_round_trip,
    "op6_toxicity": op6_toxicity,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_mixture_packing": op10_mixture_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_personal_data": op12_personal_data,
    "op13_periodic_runs": op13_periodic_runs,
}

