"""Best-fit packing into bins of several permitted lengths.

Texts are measured in tokens, cut into pieces no longer than the largest
permitted length, and dealt by hash into shards of bounded size; every shard is
packed by itself, pieces in falling order. A piece goes to the open bin that it
leaves least room in, over the bins of all lengths together. If none has room, a
bin is opened whose length costs least per token that can be expected in it,
given how the remaining pieces fill a bin of that length. Finally each bin is
downsized to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import whole_text
from labelforge.session import cut_lineage

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)

#: Pieces of one shard, about; a shard is packed in one task.
SHARD_PIECES = 20_000

#: What a bin costs besides its tokens, in tokens.
BIN_COST = 16


#: Characters of a token, at most: a longer run without white space (unspaced script, base64) is several tokens.
TOKEN_CHARS = 16


def word_count(text: Column) -> Column:
    """Tokens of a text if no tokenizer is given: its words between 0x20 and 0x09-0x0D, by TOKEN_CHARS characters."""
    return F.regexp_count(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN_CHARS}}}")).cast("long")


def pieces(docs: DataFrame, tokens: Callable[[Column], Column] = word_count, longest: int = max(LENGTHS)) -> DataFrame:
    """(doc_id, copy, piece, first_token, n_tokens): whole texts cut at multiples of ``longest``.

    ``copy`` numbers rows that repeat id and length. A text without tokens has no pieces.
    """
    sized = docs.select("doc_id", tokens(whole_text()).cast("long").alias("total")).where("total > 0")
    sized = sized.groupBy("doc_id", "total").agg(F.count("*").alias("copies"))
    copies = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    cut = F.floor((F.col("total") - 1) / longest).cast("int")
    return copies.select("doc_id", "copy", "total", F.explode(F.sequence(F.lit(0), cut)).alias("piece")).select(
        "doc_id",
        "copy",
        "piece",
        (F.col("piece").cast("long") * longest).alias("first_token"),
        F.least(F.lit(longest).cast("long"), F.col("total") - F.col("piece").cast("long") * longest).alias("n_tokens"),
    )


class _Expected:
    """What the pieces that remain would fill in a new bin of each length."""

    def __init__(self, sizes: np.ndarray, lengths: tuple[int, ...]) -> None:
        self.count = np.bincount(sizes, minlength=max(lengths) + 1)
        self.lengths = lengths
        self.present = np.flatnonzero(self.count).tolist()

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.present[bisect_left(self.present, size)]

    def filled(self, size: int, length: int) -> int:
        """Tokens in a bin that opens with ``size`` and then takes the largest remaining piece that fits, again and again."""
        room, used = length - size, size
        at = len(self.present)
        while room > 0:
            at = bisect_left(self.present, room + 1, 0, at) - 1
            if at < 0:
                break
            each = self.present[at]
            fit = min(room // each, int(self.count[each]))
            used += fit * each
            room -= fit * each
        return used


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece (sizes in falling order), and the final length of each bin."""
    lengths = tuple(sorted(lengths))
    rest = _Expected(sizes, lengths)
    room_of: list[tuple[int, int]] = []  # (room, bin) of the open bins, by room
    used: list[int] = []
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        rest.take(size)
        at = bisect_left(room_of, (size, -1))
        if at < len(room_of):
            room, b = room_of.pop(at)
        else:
            cost = lambda n: ((n + bin_cost) / rest.filled(size, n), n)
            room = min((n for n in lengths if n >= size), key=cost)
            b = len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += size
        if room > size:
            insort(room_of, (room - size, b))
    return bins, offsets, [lengths[bisect_left(lengths, n)] for n in used]


def best_fit_packing(
    docs: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    tokens: Callable[[Column], Column] = word_count,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, copy, piece, first_token, n_tokens, bin_id, bin_offset, bin_length, bin_used.

    Every token of every text is in exactly one bin. Pieces are dealt to shards
    by hash, so shards are alike whatever the sources; the number of shards
    follows the number of pieces. Defined cases: null and empty texts have no
    pieces; rows that repeat id and length are told apart by ``copy``; ties in
    size are taken in order of the id's hash; a null id is an id; other columns
    are ignored; an empty table gives no rows.
    """
    cut = cut_lineage(pieces(docs, tokens, max(lengths)), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    order = F.xxhash64("doc_id", "copy", "piece")
    dealt = cut.select(
        F.col("doc_id").cast("string").alias("doc_id"),  # a null id would make pandas turn ids into floats
        "copy", "piece", "first_token", "n_tokens", order.alias("order"),
        F.pmod(order, F.lit(shards)).cast("int").alias("shard"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "order"], ascending=[False, True], kind="stable")
        bins, offsets, final = pack(pdf["n_tokens"].to_numpy(), lengths)
        size = pdf["n_tokens"].to_numpy()
        shard = pdf["shard"].astype(str).iloc[0]
        return pdf[["doc_id", "copy", "piece", "first_token", "n_tokens"]].assign(
            bin_id=[f"{shard}-{b}" for b in bins],
            bin_offset=offsets,
            bin_length=np.array(final)[bins],
            bin_used=np.bincount(bins, weights=size).astype(np.int64)[bins],
        )

    packed = dealt.groupBy("shard").applyInPandas(
        run,
        "doc_id string, copy int, piece int, first_token long, n_tokens long, "
        "bin_id string, bin_offset long, bin_length long, bin_used long",
    )
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
