"""Document fingerprints by SpotSigs.

A signature is an anchor (a common word) with the chain of content words that
follow it. The set of a text's signatures, hashed, is its fingerprint. Where no
common word stands within ``GAP`` words, in a language without a list or in
junk, every word is an anchor, which depends on the place alone and so survives
edits elsewhere. Fingerprints are compared by Jaccard likeness: sets whose
lengths are too far apart are never compared, and a comparison stops once the
threshold is out of reach.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import parallelism, whole_text
from labelforge.session import cut_lineage

#: Content words in a chain.
CHAIN = 2

#: Words without a common word after which every word is an anchor.
GAP = 8

#: Least likeness of near duplicates.
THRESHOLD = 0.8

#: Words whose hashes a worker remembers; beyond it the table starts afresh.
MEMORY_WORDS = 400_000

#: Common words of four languages.
COMMON_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his i if in is it its me my no not of on "
    "or our she so that the their them then there they this to was we were what when which who will with would you "
    "aber als am auch auf aus bei das dass dem den der des die doch ein eine einem einen einer er es für hat ich "
    "ihr im ist mit nach nicht noch nur oder sein sich sie sind so um und von vor war wenn wie wir zu zum zur "
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas "
    "plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella era es esta este la las lo los más no o para pero por que se si sin sobre su sus un "
    "una y ya".split()
)

_WORD = re.compile(r"[^\W_]+")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) & ~1 | (word in COMMON_WORDS)
        return found


_HASHES = _WordHashes()


def signatures(text: str) -> np.ndarray:
    """The sorted distinct signatures of a text; empty if it has no character but white space."""
    lowered = text.lower()
    words = _WORD.findall(lowered) or lowered.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint32)
    if len(_HASHES) > MEMORY_WORDS:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)  # lowest bit: a common word
    common = (h & np.uint64(1)).astype(bool)
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(common, place, -GAP))
    anchors = np.flatnonzero(common | (place - last >= GAP))
    content = np.flatnonzero(~common)
    mixed = h[anchors] * np.uint64(0x9E3779B97F4A7C15)
    follow = np.searchsorted(content, anchors, side="right")
    padded = np.concatenate([h[content], np.zeros(CHAIN, np.uint64)])
    for k in range(CHAIN):
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ padded[np.minimum(follow + k, len(content))]) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def to_string(found: np.ndarray) -> str:
    """Eight hex digits per signature, in order; the empty set is the empty string."""
    return found.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets (two empty sets: 1); 0 if it can't reach ``threshold``.

    The lengths bound the likeness from above, and so does every merged run:
    what one side has already lost can't come back.
    """
    short, long = sorted((len(a), len(b)))
    if not long:
        return 1.0
    if short / long < threshold or not short:
        return 0.0
    shared, step = 0, 1024
    for at in range(0, len(a), step):
        shared += np.isin(a[at : at + step], b, assume_unique=True).sum()
        most = shared + max(0, len(a) - at - step)
        if most / (len(a) + len(b) - most) < threshold:
            return 0.0
    return float(shared / (len(a) + len(b) - shared))


def signatures_column(text: Column) -> Column:
    """array<long> of a text's signatures."""

    @F.pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signatures(t or "").astype(np.int64) for t in texts], dtype=object)

    return run(text)


def length_partition(length: Column, threshold: float = THRESHOLD) -> Column:
    """Partition of a set length: sets that reach the threshold are in the same partition or the next."""
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.lit(-np.log(threshold))).cast("int")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every pair of different fingerprints of likeness ``threshold`` or more.

    ``members(doc_id, class_id)`` names each row's class, the smallest id with
    the same fingerprint; ``pairs(left_id, right_id, likeness)`` links classes,
    so copies are never expanded. Two sets of likeness t share one of the first
    ``n - ceil(t * n) + 1`` signatures in a common order; rarest first keeps
    frequent signatures out of the join. Keys are (partition, signature), so only
    sets of matching length partitions meet. Null ids make no class.
    """
    marked = cut_lineage(
        docs.where(F.col("doc_id").isNotNull()).select("doc_id", signatures_column(whole_text()).alias("spots")), "spots"
    )
    classes = cut_lineage(
        marked.groupBy("spots").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")), "spot-classes"
    )
    members = marked.join(classes, "spots").select("doc_id", "class_id")
    size = F.size("spots")
    sets = classes.where(size > 0).select("class_id", "spots", size.alias("n"))
    exploded = sets.select("class_id", "n", F.explode("spots").alias("spot"))
    spread = exploded.groupBy("spot").agg(F.count("*").alias("df")).where("df > 1")
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    # a signature of one set alone can't be shared, but keeps its place in the order: rarest first
    ordered = (
        exploded.join(spread, "spot", "left")
        .groupBy("class_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "spot"))).alias("order"))
    )
    prefix = (
        ordered.select("class_id", "n", F.explode(F.slice("order", F.lit(1), kept.cast("int"))).alias("s"))
        .where("s.df > 1")
        .select("class_id", "n", F.col("s.spot").alias("spot"), length_partition(F.col("n"), threshold).alias("part"))
    )
    left = prefix.select(F.col("class_id").alias("left_id"), F.col("n").alias("ln"), "spot", F.col("part").alias("lp"))
    probe = prefix.withColumn("lp", F.explode(F.array(F.col("part"), F.col("part") - 1)))
    right = probe.select(F.col("class_id").alias("right_id"), F.col("n").alias("rn"), "spot", "lp")
    longer = (F.col("ln") < F.col("rn")) | ((F.col("ln") == F.col("rn")) & (F.col("left_id") < F.col("right_id")))
    close = F.col("ln") >= F.lit(threshold) * F.col("rn") - 1e-9
    met = left.join(right, ["spot", "lp"]).where(longer & close).select("left_id", "right_id").distinct()
    a = sets.select(F.col("class_id").alias("left_id"), F.col("spots").alias("a"))
    b = sets.select(F.col("class_id").alias("right_id"), F.col("spots").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    likeness = shared / (F.size("a") + F.size("b") - shared)
    pairs = met.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", likeness.alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold - 1e-12), members


def _squeezed(text: Column) -> Column:
    """Texts as they cross the shuffle: UTF-8, compressed one by one."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for texts in batches:
            yield pd.Series([squeeze(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    return run(text)


def _follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by bucket and place; each is compared with the row that follows it."""
    held = None  # (bucket, id, text, signatures) of the row whose next row is awaited
    unsqueeze = zstandard.ZstdDecompressor().decompress
    columns = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        out = []
        for bucket, ahead, doc_id, squeezed in batch[["bucket", "ahead", "id", "text"]].itertuples(index=False, name=None):
            if ahead and (held is None or held[0] != bucket):
                continue  # the bucket's last row has met its next row already
            text = unsqueeze(squeezed).decode("utf-8", "surrogatepass")
            found = signatures(text)
            if held is not None and held[0] == bucket:
                out.append(_compare(held[1], held[2], held[3], text, found))
            held = None if ahead else (bucket, doc_id, text, found)
        yield pd.DataFrame(out, columns=columns)


def _compare(doc_id: str | None, text: str, own: np.ndarray, next_text: str, next_found: np.ndarray) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + next_text[: n // 2]
    changed = signatures(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
    return doc_id, n, digest, to_string(own), to_string(changed), jaccard(own, changed), jaccard(own, next_found)


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and likeness to both that and the next document.

    The next document is the one that follows in falling doc_id (after the last:
    the first); an edited text has its last floor(n / 2) code points replaced by
    the first as many of the next text, or all. Rows are dealt into ranges of
    doc_id; the first rows of a range also go to the range before it, so texts
    move once and no order over all rows is made in one task. The driver holds
    one id per range.

    Defined cases: null texts are empty; an empty text has the empty fingerprint
    and likeness 1 to another empty one; rows that repeat an id follow each other
    in order of their text's hash; null ids come last; a single row is its own next; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", _squeezed(whole_text()).alias("text"), F.xxhash64(whole_text()).alias("tie"))
    ids = docs.select("doc_id")
    width = parallelism(spark)
    points = [i / width for i in range(1, width)]
    cuts = ids.agg(F.percentile_approx("doc_id", points or [0.5], 100 * width).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    # ranges in falling order; null ids are a range of their own at the end
    bucket = F.coalesce(F.lit(len(cuts)) - _range_of(F.col("doc_id"), cuts), F.lit(len(cuts) + 1)).cast("int")
    firsts = ids.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    found = sorted((r["bucket"], r["first_id"]) for r in firsts.collect())
    before = {b: found[k - 1][0] for k, (b, _) in enumerate(found)}  # of the first range: the last
    ahead = spark.createDataFrame([(before[b], i, b) for b, i in found], f"to_bucket int, first_id {docs.schema['doc_id'].dataType.simpleString()}, of int")
    placed = rows.withColumn("bucket", bucket)
    match = (placed["bucket"] == ahead["of"]) & placed["doc_id"].eqNullSafe(ahead["first_id"])
    both = placed.join(F.broadcast(ahead), match, "left").select(
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        "text",
        "tie",
        F.explode(
            F.when(F.col("to_bucket").isNull(), F.array(F.struct("bucket", F.lit(False).alias("ahead")))).otherwise(
                F.array(
                    F.struct("bucket", F.lit(False).alias("ahead")),
                    F.struct(F.col("to_bucket").alias("bucket"), F.lit(True).alias("ahead")),
                )
            )
        ).alias("at"),
    )
    dealt = (
        both.select("id", "doc_id", "text", "tie", F.col("at.bucket").alias("bucket"), F.col("at.ahead").alias("ahead"))
        .repartitionById(len(cuts) + 2, F.col("bucket"))
        .sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "tie")
        .select("bucket", "ahead", "id", "text")
    )
    out = dealt.mapInPandas(
        _follow,
        "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    doc_id = F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return out.select(doc_id, *[c for c in out.columns if c != "id"])


def _range_of(value: Column, cuts: list) -> Column:
    """How many cuts are below the value, by halving (a nested CASE of logarithmic depth); null for null."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(cuts[mid]), part(mid + 1, hi)).otherwise(part(lo, mid))

    return F.when(value.isNotNull(), part(0, len(cuts)))
