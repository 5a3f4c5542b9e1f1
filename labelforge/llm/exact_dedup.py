"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is normalised (every white-space run becomes one space) and cut where
its own content says so: at the first sentence end after ``MIN_CHUNK``
characters, or at ``MAX_CHUNK``. Equal texts are cut alike, and an edit moves
only the cuts near it. Chunks are deduplicated to identifiers that are verified
against the chunk text; a document is then the ordered list of its chunk
identifiers (its recipe), and only recipes are grouped and joined. The chunk
text crosses the network once, after a map-side distinct; whole documents never
do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import whole_text
from labelforge.session import cut_lineage

# Fixed values of the contract: the white space that is collapsed.
WHITESPACE = r"[\x20\x09-\x0D]+"

MIN_CHUNK = 512
MAX_CHUNK = 4096


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE, " ")


def chunk_pattern(min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> str:
    return rf"(?s).{{{min_chunk},{max_chunk}}}?(?<=[.!?。！？] )|.{{1,{max_chunk}}}"


def chunks(text: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """The content-defined chunks of a normalised text, in order (none for the empty text)."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(min_chunk, max_chunk)), F.lit(0))


def recipes(
    docs: DataFrame,
    min_chunk: int = MIN_CHUNK,
    max_chunk: int = MAX_CHUNK,
    chunk_hash: Callable[[Column], Column] = lambda c: F.xxhash64(c),
) -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered list of verified chunk identifiers per row.

    An identifier is the 64-bit hash of the chunk and, where several different
    chunk texts share that hash, the rank of the text among them.
    """
    spark = docs.sparkSession
    cut = docs.select("doc_id", normalise(whole_text()).alias("norm")).select(
        "doc_id", "norm", chunks(F.col("norm"), min_chunk, max_chunk).alias("parts")
    )
    slim = cut_lineage(
        cut.select(
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform("parts", lambda c: chunk_hash(c)).alias("hashes"),
        ),
        "recipes",
    )
    pieces = cut.select(F.explode("parts").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk")
    distinct = pieces.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    clashes = cut_lineage(
        distinct.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "chunk-clashes"
    )
    unranked = F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(1).alias("rank")))
    if clashes.isEmpty():  # every hash stands for one text: verified as it is
        return slim.select("doc_id", "text_sha256", unranked.alias("recipe"))
    # Some hash stands for several texts: rank the texts of those hashes alone.
    ranks = (
        pieces.join(clashes, "h", "left_semi")
        .groupBy("h")
        .agg(F.array_sort(F.collect_set("chunk")).alias("texts"))
    )
    fixed = (
        cut.select(F.sha2("norm", 256).alias("text_sha256"), F.posexplode("parts").alias("pos", "chunk"))
        .withColumn("h", chunk_hash(F.col("chunk")))
        .join(ranks, "h")
        .groupBy("text_sha256", "pos")
        .agg(F.max(F.array_position("texts", F.col("chunk")).cast("int")).alias("rank"))
        .groupBy("text_sha256")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "rank"))).alias("rank_at"))
    )
    ranked = F.transform(
        "hashes",
        lambda h, i: F.struct(h.alias("h"), F.coalesce(F.try_element_at(F.col("rank_at"), i), F.lit(1)).alias("rank")),
    )
    out = slim.join(fixed, "text_sha256", "left").select("doc_id", "text_sha256", ranked.alias("recipe"))
    return cut_lineage(out, "ranked-recipes")


def exact_dedup(docs: DataFrame, **chunking) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their recipes are. Defined cases: a null text is the
    empty text, whose recipe is the empty list; of rows that repeat both id and
    text one is kept; a null id never beats another id and is kept only in a
    group of null ids; extra columns are ignored; an empty table gives none.
    """
    # rows that repeat id and text are one row with a number from here on
    rows = recipes(docs, **chunking).groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("copies"))
    rows = cut_lineage(rows, "recipe-rows")
    groups = rows.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    joined = rows.join(groups, "recipe")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return joined.select("doc_id", "keep_id", "group_size", "text_sha256", copy).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )
