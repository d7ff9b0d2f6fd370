"""The queries over the given tables, one per operator, with production parameters."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm import chat, decontaminate, exact_dedup, filter_audit, jaccard, licenses, lines, packing, quality, search, secrets, token_store, url_filter
from barweave.llm.common import Scratch, small_batches

END_ID = 2
CAPACITY = 1024


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs, room = table(spark, folder, "documents"), Scratch(spark, "tokens")
    store = token_store.write_store(docs, room.folder, tokenizer_file("word_bpe_49k.json"), END_ID, special=True)
    stored = store.table(spark, "entries").select("key", "copy")  # rows that share an id are copies of it
    rows = token_store.read_ids(store, token_store.look_up(store, stored, key="key"))
    return rows.select(
        F.col("key").alias("doc_id"), F.col("start").cast("long"), F.col("length").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


# The site's own rules, host and start of the path.
SITE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    site = [url_filter.place_rule(verdict, place) for verdict, place in SITE_RULES]
    judged = url_filter.filter_urls(table(spark, folder, "pages").select("page_id", "url"), site + url_filter.DEFAULT_RULES)
    own = F.col("matched").isin([place for _, place in SITE_RULES])
    return judged.select("page_id", "host", "path", F.when(own, F.col("matched")).alias("rule"), "verdict", "matched")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    found = licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    shown = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["first"], m["last"]))
    return found.select(
        "doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(shown, ",").alias("matches"),
        F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("best_coverage"),
    )


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_pieces(spark, table(spark, folder, "documents"))


def packed_pieces(spark: SparkSession, docs: DataFrame) -> DataFrame:
    packed = packing.pack(docs, Scratch(spark, "packing"), tokenizer_file("byte_bpe_50k.json"), END_ID, CAPACITY, special=True)
    pieces = packed.pieces.select("row", "key", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces.join(packed.places, ["row", "piece"]).select(
        F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    room = Scratch(spark, "jaccard")
    found, _ = jaccard.linked_documents(table(spark, folder, "documents"), room, 3, Fraction(9, 10))
    return settled(found, room).select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def settled(result: DataFrame, room: Scratch) -> DataFrame:
    """The result on disk, and everything it was made from gone."""
    last = Scratch(room.spark, "result")
    kept = last.save(result, "rows")
    room.drop("")
    return kept


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, cut further into sentences."""
    kept = lines.repeated_units(table(spark, folder, "documents"))
    spans = F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return kept.select(
        F.col("key").alias("doc_id"), F.col("n_units").cast("long"), F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["units"]).alias("n_removed"),
        F.array_join(spans, ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, folder, "benchmark"))
    c = "contamination"
    return found.select(
        "doc_id", f"{c}.n_words", f"{c}.n_hit", F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f"{c}.items"), ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, folder, "documents"), Scratch(spark, "exact"))
    return found.select(
        F.col("key").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    repository = docs.withColumn("repository", F.concat_ws("/", "source", "lang"))
    found = secrets.find_secrets(repository, Scratch(spark, "secrets"), repository="repository", owner="source")

    def number(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("key").alias("doc_id"), *[number(i).alias(f"n_{name}") for i, (name, *_) in enumerate(secrets.BASE)],
        F.sha2(secrets.span_list(F.col("base")), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
    )


def fold(key: str = "doc_id"):
    """Rows of remainder 1 are held out from fitting."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    return quality.fit_quality(docs, labels.where(fold() != 1).select("doc_id", "quality"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    score = quality.score_udf(quality_model(docs, table(spark, folder, "labels")))
    scored = docs.select("doc_id", (fold() == 1).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return filter_audit.filter_orders(docs, labels, Scratch(spark, "audit"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    index = search.build_index(table(spark, folder, "documents"), Scratch(spark, "search"))
    return search.search(index, table(spark, folder, "benchmark")).withColumnRenamed("item", "item_id")


def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Rows by turn are records of messages; conversation -1 comes as a prompt with its response."""
    hard = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), hard.alias("prompt"), hard.alias("response"))
    records = chat.records_of_rows(table(spark, folder, "conversations")).unionByName(probe, allowMissingColumns=True)
    turns = chat.canonical_turns(records)
    written = turns.select("conv_id", chat.format_turns(F.col("turns")).alias("segments"))
    read = Scratch(spark, "chat").save(written, "formatted").withColumn("formatted", chat.formatted_text(F.col("segments")))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_store, op2_url_filter, op3_license_scan, op4_best_fit_packing, op5_jaccard_join, op6_line_dedup,
        op7_decontamination, op8_exact_dedup, op9_secret_scan, op10_quality, op11_filter_audit,
        op12_lexical_search, op13_chat_format,
    )
}
