"""The registered queries of this subpackage; each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import contamination, fill_middle, html_text, licenses, near_duplicates, neighbours, oracles, packed_files, packing, personal_data, quotes, repetition, urls, vector_codes
from turnwise.llm.common import fresh_path
from turnwise.session import configure
from turnwise.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, directory: build(configure(spark), directory)
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


@query("op6_quality_rules", oracles.quality_rules(repetition.RepetitionRules()))
def quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    found = repetition.repetition_coverage(read_table(spark, directory, "documents"), keep=["doc_id"])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts)


#: (verdict, host and path)
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@query("op8_url_filters", oracles.url_filters(URL_RULES))
def url_filters(spark: SparkSession, directory: str) -> DataFrame:
    judged = urls.judge_urls(read_table(spark, directory, "pages"), urls.UrlRules(rules=URL_RULES), keep=["page_id"])
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op9_benchmark_decontamination", oracles.decontamination(contamination.WINDOW))
def benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    docs, items = read_table(spark, directory, "documents"), read_table(spark, directory, "benchmark")
    found = contamination.find_items(docs, items, keep=["doc_id"], with_text=False)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda total, run: total + run["after"] - run["first"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


@query("op4_token_files")
def token_files(spark: SparkSession, directory: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    packed_files.write_token_files(read_table(spark, directory, "documents"), path, special_as_text=False)
    return packed_files.read_documents(spark, path)


@query("op10_near_duplicates", oracles.near_duplicates(near_duplicates.SHINGLE, near_duplicates.SIMILAR))
def near_duplicate_groups(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates.near_duplicates(read_table(spark, directory, "documents"))


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    cut = packing.pieces(read_table(spark, directory, "documents"), with_ids=False, special_as_text=False)
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op3_personal_data")
def personal_data_spans(spark: SparkSession, directory: str) -> DataFrame:
    found = personal_data.find_spans(read_table(spark, directory, "documents"), personal_data.train(spark), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(personal_data.span_text(F.col("base")), 256).alias("base_sha256")
    return found.select(F.col("row.doc_id").alias("doc_id"), *map(count, personal_data.KINDS), base, personal_data.span_text(F.col("spans")).alias("spans"))


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    found = html_text.main_text(read_table(spark, directory, "pages"), keep=["page_id", "url"])
    return found.select("row.*", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op1_license_scan", licenses.oracle())
def license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan(read_table(spark, directory, "documents"))


@query("op7_quotation_linking")
def quotation_linking(spark: SparkSession, directory: str) -> DataFrame:
    return quotes.link_quotations(read_table(spark, directory, "conversations"))


NEAREST = 20


@query("op11_nearest_neighbours", oracles.nearest_neighbours(NEAREST, 20))
def nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    vectors = read_table(spark, directory, "embeddings")
    index = neighbours.build_index(vectors, NEAREST)
    return neighbours.search_index(index, vectors.where(F.col("vec_id") % 20 == 0), NEAREST)


@query("op12_vector_codes", oracles.vector_codes(vector_codes.ENTRIES, vector_codes.PARTS, vector_codes.ROUNDS, vector_codes.SCALE))
def vector_code_table(spark: SparkSession, directory: str) -> DataFrame:
    codes, books = vector_codes.compress(read_table(spark, directory, "embeddings"))
    digest = F.lit(books.digest() if books else "")
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


@query("op13_fill_in_middle", oracles.fill_in_middle(fill_middle.MiddleRules()))
def fill_in_middle(spark: SparkSession, directory: str) -> DataFrame:
    framed = fill_middle.frame_texts(read_table(spark, directory, "documents"), keep=["doc_id"])
    made = fill_middle.digests(fill_middle.fill_in_middle(framed))
    return made.select(F.col("row.doc_id").alias("doc_id"), F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
