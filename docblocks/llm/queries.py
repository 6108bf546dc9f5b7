"""The queries of the thirteen operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fertility, grammar, lattice, lines, pulearn, resampling, ring, setsketch, spaced, suffixes, variants, warc
from .oracles import ORACLES
from .tables import read, remainder, shared_folder, vocabulary


#: Rows whose crc32 of the id leaves this remainder by 4 are held out of the classifiers.
HELD_OUT = 2


def _verdict(scored: DataFrame, least: float) -> DataFrame:
    held = F.coalesce(remainder("doc_id", 4) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by positive-unlabelled learning."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    learn = remainder("doc_id", 4) != HELD_OUT
    positives = read(spark, sf_dir, "labels").where(learn & (F.col("quality") == 1))
    net = pulearn.train(docs, positives, docs.where(learn))
    return _verdict(pulearn.score(docs, net), 0.7)


def op2_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    found = setsketch.groups(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text by the subword lattice, and by plain word counts."""
    scored = lattice.score(read(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0, vocabulary("piece_bpe_32k.model"))
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the pattern grammar."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = grammar.train(docs, read(spark, sf_dir, "labels").where(remainder("doc_id", 4) != HELD_OUT))
    return _verdict(grammar.score(docs, lexicon), 0.3)


def op3_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that long repeats cover, and a digest of the others."""
    found = suffixes.dedup(read(spark, sf_dir, "documents"), text_out=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), "kept_sha256")


#: Shards of op 4.
SHARDS = 24


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document on the bounded ring; the law is ``rows``."""
    rows = ring.shard(read(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with its best overlap."""
    return spaced.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and removed of every document, and a digest of what is left."""
    return lines.dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_lines",
        F.col("n_lines_removed").alias("n_removed"),
        F.octet_length("text").alias("n_bytes_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.encode(read(spark, sf_dir, "documents"), path, offsets=False, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict for every text."""
    judged = fertility.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), vocabulary("piece_bpe_32k.model"))
    return judged.select(
        "doc_id",
        *[F.col(f"measures.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
        *[F.col(f"measures.{c}").alias(c) for c in ("n_tokens", "chars_per_token", "byte_share", "entropy")],
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all texts, the misspelt ones planted by the contract included, with its form and root."""
    counts = variants.word_counts(read(spark, sf_dir, "documents"), planted=199)
    return variants.group(counts.where(F.col("n") >= 5))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's features, with the rank of those drawn."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10)


def op13_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back from them."""
    archive = f"{shared_folder(spark)}/archive"
    warc.write(read(spark, sf_dir, "pages"), archive)
    found = warc.pages_of(spark, archive)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pu_quality": op1_pu_quality,
        "op2_setsketch": op2_setsketch,
        "op3_suffix_levels": op3_suffix_levels,
        "op4_bounded_ring": op4_bounded_ring,
        "op5_subword_lattice": op5_subword_lattice,
        "op6_toxicity_grammar": op6_toxicity_grammar,
        "op7_spaced_seeds": op7_spaced_seeds,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_line_winnowing": op9_line_winnowing,
        "op10_fertility_rules": op10_fertility_rules,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_warc_transactions": op13_warc_transactions,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
