"""Corpus pipeline: toxicity, SimHash near-duplicates, substring duplicates, contamination, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the
next one. All but the last return the columns of documents; the last adds the encoded ids to doc_id.

Defined cases, for every stage: rows are told apart by their place in the stored input, so a null or repeated doc_id joins
or drops nothing; other columns, of any name, are carried along; null and empty texts are clean, alike, and
encoded to no ids; an empty table gives an empty result; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skipjack.llm import toxicity
from skipjack.llm.common import remove, scratch, stored, table
from skipjack.llm.decontaminate import find_contamination
from skipjack.llm.pieces import encode_pieces
from skipjack.llm.queries import PIECES_MODEL, tokenizer_path
from skipjack.llm.simhash import near_duplicates
from skipjack.llm.substring import deduplicate_substrings
from skipjack.session import importable

#: Words of a shingle, and the similarity from which two documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Score from which a document is toxic.
TOXIC = 0.5


def _numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): doc holds all columns; row is the file's number and the place in the file, which every reading gives alike."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc")
    try:
        file = docs.metadataColumn("_metadata")
        placed = docs.select(whole, file["file_path"].alias("file"), file["row_index"].alias("place"))
        names = sorted(r["file"] for r in placed.select("file").distinct().collect())  # one name per file
    except AnalysisException:  # rows that lie in no Parquet file are stored first
        return stored(docs.select(whole, F.monotonically_increasing_id().alias("row")), "numbered")
    files = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "file string, number long")
    return placed.join(F.broadcast(files), "file").select((F.shiftleft("number", 40) + F.col("place")).alias("row"), "doc")


def _texts(numbered: DataFrame) -> DataFrame:
    return numbered.select("row", F.col("doc")["text"].alias("text"))


def _kept(docs: DataFrame, numbered: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of docs of the rows whose number is in rows."""
    return numbered.join(rows.select("row"), "row", "left_semi").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored TOXIC or more go."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    numbered = _numbered(docs)
    scored = toxicity.score_toxicity(_texts(numbered), index, id_col="row")
    return _kept(docs, numbered, scored.where(F.col("score") < TOXIC).select(F.col("doc_id").alias("row")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: the one with the least doc_id (null: last), of those the first.

    Groups are linked by fingerprints over shingles of five words that differ in at most three bits, and by an exact similarity of
    0.8 or more between the texts' shingle sets.
    """
    numbered = _numbered(docs)
    found = near_duplicates(_texts(numbered), id_col="row", row_col="row", size=SHINGLE, similarity=SIMILARITY).select("row", "component_id")
    # Least doc_id, null last; the group's rows are summed per task before they meet.
    id_of = F.col("doc")["doc_id"]
    place = F.struct(id_of.isNull().alias("none"), id_of.alias("doc_id"), F.col("row"))
    first = numbered.select("row", place.alias("place")).join(found, "row").groupBy("component_id").agg(F.min("place").alias("first"))
    return _kept(docs, numbered, first.select(F.col("first.row").alias("row")))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start in an earlier document are cut; documents of which nothing is left go."""
    numbered = _numbered(docs)
    texts = numbered.select("row", F.col("doc")["doc_id"].alias("doc_id"), F.col("doc")["text"].alias("text"))
    found = deduplicate_substrings(texts, row_col="row").where("n_words = 0 OR n_removed < n_words").select("row", "kept_text", "n_removed")
    joined = numbered.join(found, "row")
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    numbered = _numbered(docs)
    found = find_contamination(_texts(numbered), table(spark, sf_dir, "benchmark"), id_col="row")
    return _kept(docs, numbered, found.where("n_hit = 0").select(F.col("doc_id").alias("row")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of the text's pieces, their number and check sum, and whether they decode to the text."""
    return encode_pieces(docs, tokenizer_path(PIECES_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
STAGES = [(name, importable(stage)) for name, stage in STAGES]

#: SQL expresses neither the neighbour scores nor the SimHash groups; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        if k:
            remove(spark, f"{path}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
