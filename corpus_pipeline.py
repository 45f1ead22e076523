"""A training corpus from raw documents, in five stages of operators from weftgraph.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
docs. run() writes each stage's rows as Parquet in the shared folder and reads them again for the next.

Rows without text go in the first stage. The near-duplicate stage follows operator 9 and tells rows apart by doc_id and text, so
rows that share an id or have none go only because of their text. Extra columns pass through. A document that loses all its lines stays, with an empty text, until
the near-duplicate stage joins it with the other empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontam, langid, linededup, simhash
from weftgraph.llm._runtime import checkpointed, stored
from weftgraph.runtime import remove, scratch

#: run() has no SQL form: learned models, tokenisation and components are in it. It is tested against a brute-force version.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> DataFrame:
    """row (all columns) and text: operators that keep their id column then carry whole rows."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; a document that names none gets the one predicted."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(_whole(docs), model, id_col="row").where(F.col("lang_pred") != langid.UND)
    now = {"lang": F.coalesce(F.col("doc_id.lang"), F.col("lang_pred"))}
    return found.select(*[now.get(c, F.col(f"doc_id.{c}")).alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are cut from the text."""
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[now[c].alias(c) if c in now else docs[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows, the one with the smallest (doc_id, text) stays, null ids last; of rows equal in both, the one whose
    other columns are the least as JSON.

    A row's mark is its id and the digest of its text. Groups name their least mark; only where several texts of a group have
    the least id, or all lack one, are the texts themselves compared.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    mark = F.struct(docs["doc_id"].isNull().alias("none"), docs["doc_id"].alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    found = simhash.groups(docs.select(mark.alias("mark"), docs["text"]), id_col="mark")
    least = (F.col("doc_id.none") == F.col("component_id.none")) & F.col("doc_id.id").eqNullSafe(F.col("component_id.id"))
    able = checkpointed(found.where(least).select(F.col("doc_id").alias("mark"), F.col("component_id").alias("group")).distinct())
    count = able.groupBy("group").agg(F.count("*").alias("n"))
    tied = able.join(count.where("n > 1"), "group").select("mark", "group")
    stay = able.join(count.where("n = 1"), "group").select("mark")
    if not tied.isEmpty():
        texts = docs.select(mark.alias("mark"), text.alias("text")).join(tied, "mark")
        stay = stay.union(texts.groupBy("group").agg(F.min_by("mark", "text").alias("mark")).select("mark"))
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c not in ("doc_id", "text")]))
    rows = docs.select(mark.alias("mark"), others.alias("others"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(stay, "mark", "left_semi").groupBy("mark").agg(F.min_by("row", "others").alias("row")).select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in benchmark windows go."""
    found = decontam.hits(_whole(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return found.where(~((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select("doc_id.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        with scratch(spark) as made:  # what a stage stores on its way goes, its rows stay until the next one's are written
            docs = stored(stage(spark, docs, sf_dir))
            rows = [made.pop()]
        remove(spark, earlier)
        earlier = rows
    return docs
