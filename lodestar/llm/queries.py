"""One query for each operator, with production parameters, over its whole table.

``ORACLES`` holds the SQL of those that SQL can express; the others are tested against
brute force, exact round trips or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import oracles
from lodestar.llm.filter_audit import audit_filters
from lodestar.llm.line_dedup import line_digests
from lodestar.llm.near_duplicates import near_duplicate_classes
from lodestar.llm.neighbours import nearest_by_lists
from lodestar.llm.packing import pack
from lodestar.llm.pii_crf import find_personal_data, fit_pii_field
from lodestar.llm.quality_rules import score_quality
from lodestar.llm.resampling import resample
from lodestar.llm.sentence_pieces import encode_and_decode
from lodestar.llm.shipping import ship_package
from lodestar.llm.substrings import remove_repeats
from lodestar.llm.toxicity import fit_toxicity, score_toxicity
from lodestar.llm.url_templates import CELLS, Rule, TemplateSettings, judge_urls
from lodestar.llm.wavelet import read_token_shards, write_token_shards
from lodestar.sources.tables import read_table

URL_RULES = [
    Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False), Rule("net", "/fr/", False),
]
TEMPLATES = TemplateSettings()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op4_bagminhash": oracles.NEAR_DUPLICATES,
    "op6_suffix_repetition": oracles.QUALITY,
    "op8_line_neighbourhoods": oracles.LINES,
    "op9_repeated_windows": oracles.REPEATS,
    "op12_path_templates": oracles.urls(
        [(r.host, r.path, r.allow) for r in URL_RULES], TEMPLATES.levels, TEMPLATES.most_branches,
        TEMPLATES.most_distance, TEMPLATES.least_purity, CELLS,
    ),
    "op13_filter_interactions": oracles.INTERACTIONS,
}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its own name."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards written as wavelet matrices and read back, a row per document."""
    path = write_token_shards(read_table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    return read_token_shards(spark, path).drop("ids")


@query
def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences that hold the corpus's mix of sources."""
    return pack(read_table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


@query
def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, repetition by suffix array and verdict of every document."""
    return score_quality(read_table(spark, sf_dir, "documents")).select("doc_id", "quality.*").drop("longest_repeat")


@query
def op9_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once runs of 50 words of earlier documents are gone."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


@query
def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, by the least doc_id in it."""
    return near_duplicate_classes(read_table(spark, sf_dir, "documents")).drop("t")


@query
def op8_line_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many repeat an earlier one, and the digest of the rest."""
    return line_digests(read_table(spark, sf_dir, "documents"))


@query
def op10_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth vector id."""
    return nearest_by_lists(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op2_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit_toxicity(docs, labels.filter(~held_out))
    return score_toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op1_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of base spans, and all spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, fit_pii_field(docs))
    return found.select("doc_id", "pii.*").drop("masked")


@query
def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by a SentencePiece model, and the text decoded from them."""
    return encode_and_decode(read_table(spark, sf_dir, "documents"), PIECES)


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark, and ranks of the tenth drawn."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op12_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by the listed rules, else by the template of its path."""
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES, settings=TEMPLATES)


@query
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by source."""
    fails = [
        ("A", F.col("n_words") < 200),
        ("B", 100 * F.col("n_distinct") < 50 * F.col("n_words")),
        ("C", 100 * F.col("n_capitals") > 2 * F.col("n_points")),
        ("D", F.col("n_symbols") > 0),
        ("E", F.col("copy")),
    ]
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fails)
