"""The queries op1 to op10 and what SQL can say of them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, linededup, mixing, packing, pii, qualityrules, simhash, topk, toxicity, warc
from .common import stash, table
from .oracles import ORACLES  # noqa: F401


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as often as its source's quota takes it, with its place; odd rows as in ``mixing.mixed``: null or wordless texts once an epoch, null sources as the source ''."""
    taken = mixing.mixed(table(spark, sf_dir, "documents"), mixing.Mix(max_repeats=1.5), keys=True)
    return taken.select("doc_id", "source", "epoch", "block", "block_key", "row_key", "tokens")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as lines without their host's boilerplate, and the number dropped.  A null address is the host '', a null page stays null, repeated rows are pages each."""
    pages = table(spark, sf_dir, "pages").select("page_id", linededup.page_host(F.col("url")).alias("host"), linededup.page_lines(F.col("html")).alias("text"))
    return linededup.drop_boilerplate(stash(pages, "page-lines"), dropped_col="n_dropped")  # counted and filtered: extract once


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 tokens.  A null or empty text is its end token alone; repeated rows are packed each; a null id stays null; an empty table gives none."""
    packed = packing.pack_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.  Null and wordless texts have fingerprint zero and link like any other; a null id is replaced by a negative one made from the text; repeated rows are each returned."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document; null texts have no words and fail, null sources are the source '', repeated rows are each returned."""
    return qualityrules.rules(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every 50th vector; null, empty and non-finite vectors and rows without an id take no part, ties go to the smaller id."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with personal data replaced; null and empty texts stay, repeated rows come out alike."""
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), "gridwright-demo-key", count_col="n_replaced")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; null and empty texts are scored too, null ids are not held out, repeated rows are each returned."""
    scored = classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def damaged(recs: DataFrame) -> DataFrame:
    """A second replica: some bodies zeroed, some with a wrong first byte, some records lost and some inserted within files."""
    k = F.col("record_id")
    head = F.substring_index("record", "\r\n\r\n", 1)
    body = F.expr("substring(record, length(substring_index(record, '\r\n\r\n', 1)) + 5)")
    zeroed = F.concat(head, F.lit("\r\n\r\n"), F.repeat(F.lit("0"), F.octet_length(body) - 4), F.lit("\r\n\r\n"))
    record = F.when(k % 389 == 11, zeroed).when(k % 97 == 5, F.concat(F.lit("w"), F.expr("substring(record, 2)"))).otherwise(F.col("record"))
    # Inserted records come first in their file: all others of it move.
    inserted = F.when(k % 211 == 7, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    df = recs.withColumn("record", record).where("not (file % 3 = 1 and record_id % 101 = 50)").withColumn("new", F.explode(inserted))
    record_id, record = F.when(F.col("new"), -1 - k).otherwise(k), F.when(F.col("new"), F.lit("inserted")).otherwise(F.col("record"))
    return df.select("file", record_id.alias("record_id"), F.octet_length(record).cast("long").alias("length"), record.alias("record"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records by which a damaged replica of ``pages`` differs; null ids, empty bodies and repeated rows are records as ``warc.records`` says."""
    recs = warc.records(table(spark, sf_dir, "pages"))
    return warc.audit(recs, damaged(recs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; null and empty texts are scored too, null ids are not held out, repeated rows are each returned."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = classifier.held_out(F.col("doc_id"))
    model = toxicity.train(toxicity.sample(docs, labels.where(~held), "toxic"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_line_dedup, op3_packing, op4_simhash_near_dedup, op5_quality_rules, op6_exact_topk, op7_pii_pseudonyms, op8_quality_classifier, op9_warc_fixity, op10_toxicity)}


