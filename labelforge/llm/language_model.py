"""LM scoring by deleted interpolation.

P1(w) = a f(w) + (1 - a) / (V + 1) and P(w | v) = b f(w | v) + (1 - b) P1(w),
where f are maximum-likelihood estimates, V counts the distinct training tokens
and b depends on the bucket of the context's frequency. The weights come from
expectation-maximisation on held-out counts: ``a`` leaves out one token at a
time, ``b`` is learned on the tokens of a seventh of the training rows, whose
blocks are deleted from the counts while they are held out.

How it runs: tasks turn runs of texts into blocks (token numbers of a sorted
block vocabulary, compressed). Each block asks for the corpus counts of its
distinct unigrams and bigrams, once per key, in sorted slices by key range. A
range task adds up the training counts of all blocks and answers each in its own
order. Answers meet their block again by block id, and the block scores its
texts. A key costs one entry per block however frequent it is, so no word, pair
or source makes a hot group, and counts grow with the corpus in the shuffle,
never on the driver. The driver gets histograms of fixed size for the weights.

Tokens are known by the 64-bit hash of their word, bigrams by ``BIGRAM_BITS``
bits of a hash of the pair.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import crc_fold, parallelism, whole_text
from labelforge.session import cut_lineage

# Fixed values of the contract: rows of this fold are never learned from.
FOLDS = 7
TEST_FOLD = 2

#: The fold of training rows on which the bigram weights are learned.
WEIGHT_FOLD = 3

#: Characters of text in a block, about (a longer text is a block of its own).
BLOCK_CHARS = 12 << 20

#: Bits of a bigram's key: some 2 ** 52 keys keep collisions rare up to 10 ** 10 distinct bigrams.
BIGRAM_BITS = 52

#: Tokens per range task, about.
RANGE_TOKENS = 4_000_000

#: Context-frequency buckets: powers of two, the last is open.
BUCKETS = 16

#: Up to this count every count has a bin of its own for the unigram weight; above it bins are ``LEAVE_ONE_STEP`` wide.
LEAVE_ONE_CAP = 1000

#: Width of the bins of larger counts, in natural logarithms. No count is clipped: 63 bits make some 7500 bins.
LEAVE_ONE_STEP = 0.005

#: Width of the bins of log ratios that the bigram weights are learned from.
RATIO_STEP = 0.05


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    width = 8 if values.dtype.itemsize == 8 else 4
    return zstandard.compress(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def _unplanes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, 8), dtype=np.uint64)


def bigram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ ((second << np.uint64(32)) | (second >> np.uint64(32)))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed >> np.uint64(64 - BIGRAM_BITS)


def tokens_of(text: str) -> list[bytes]:
    """Words between 0x20 and 0x09-0x0D with A-Z in lower case, without the end token."""
    return text.encode("utf-8", "replace").lower().split()


_BLOCK_SCHEMA = "block string, weigh boolean, n_tokens long, ids array<string>, folds array<int>, sizes binary, tokens binary, words binary"


def _encode(block_chars: int):
    """Blocks of a partition's rows; rows of the weight fold make blocks of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number = TaskContext.get().partitionId(), count()
        open_blocks: dict[bool, list] = {False: [], True: []}
        chars = {False: 0, True: 0}
        for batch in batches:
            for doc_id, fold, text in zip(batch["id"], batch["fold"], batch["text"]):
                weigh = fold == WEIGHT_FOLD
                open_blocks[weigh].append((doc_id, fold, text))
                chars[weigh] += len(text)
                if chars[weigh] >= block_chars:
                    yield _block(f"{part}-{next(number)}", weigh, open_blocks[weigh])
                    open_blocks[weigh], chars[weigh] = [], 0
        for weigh, rows in open_blocks.items():
            if rows:
                yield _block(f"{part}-{next(number)}", weigh, rows)

    return run


def _block(name: str, weigh: bool, rows: list[tuple]) -> pd.DataFrame:
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    end = numbers[b""]
    sizes, found = [], []
    for _, _, text in rows:
        words = tokens_of(text)
        found.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
        found.append(np.array([end], np.uint32))
        sizes.append(len(words) + 1)
    tokens = np.concatenate(found)
    keys = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype=np.uint64, count=len(numbers))
    order = np.argsort(keys)
    place = np.empty(len(keys), np.uint32)
    place[order] = np.arange(len(keys), dtype=np.uint32)
    row = {
        "block": name,
        "weigh": weigh,
        "n_tokens": len(tokens),
        "ids": [r[0] for r in rows],
        "folds": [int(r[1]) for r in rows],
        "sizes": _planes(np.array(sizes, np.uint32)),
        "tokens": _planes(place[tokens]),
        "words": pack_sorted(keys[order]),
    }
    return pd.DataFrame([row])


@dataclass
class _Opened:
    """A block with its distinct keys: where each token stands among the words and the bigrams."""

    sizes: np.ndarray
    folds: np.ndarray
    word: np.ndarray  # number of each token's word
    context: np.ndarray  # number of the word before it; the end token before a text's first
    words: np.ndarray
    pair: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def of(row: pd.Series) -> _Opened:
        sizes = _unplanes(row["sizes"], 4).astype(np.int64)
        word = _unplanes(row["tokens"], 4).astype(np.int64)
        words = unpack_sorted(row["words"])
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[0] = word[-1]  # every text ends with the end token, so the one before a text is the end token
        pairs, pair = np.unique(bigram_keys(words[context], words[word]), return_inverse=True)
        return _Opened(sizes, np.asarray(row["folds"]), word, context, words, pair, pairs)

    def training(self) -> np.ndarray:
        return np.repeat(self.folds != TEST_FOLD, self.sizes)

    def own_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the block itself per word and per bigram."""
        train = self.training()
        return (
            np.bincount(self.word[train], minlength=len(self.words)),
            np.bincount(self.pair[train], minlength=len(self.pairs)),
        )


def _bounds(ranges: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // ranges for i in range(1, ranges)], dtype=np.uint64)


def _requests(ranges: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                block = _Opened.of(row)
                out = []
                for order, keys, own, bits in zip((1, 2), (block.words, block.pairs), block.own_counts(), (64, BIGRAM_BITS)):
                    cuts = np.concatenate([[0], np.searchsorted(keys, _bounds(ranges, bits)), [len(keys)]])
                    out += [
                        (r, order, row["block"], pack_sorted(keys[s:e]), _planes(own[s:e].astype(np.uint32)))
                        for r, (s, e) in enumerate(zip(cuts[:-1], cuts[1:]))
                        if e > s
                    ]
                yield pd.DataFrame(out, columns=["range", "order", "block", "keys", "own"])

    return run


def count_bins(total: np.ndarray) -> np.ndarray:
    """Bin of each count for the unigram weight: the count itself, or of log width above ``LEAVE_ONE_CAP``."""
    above = np.floor(np.log(np.maximum(total, LEAVE_ONE_CAP) / LEAVE_ONE_CAP) / LEAVE_ONE_STEP).astype(np.int64)
    return np.where(total <= LEAVE_ONE_CAP, total, LEAVE_ONE_CAP + 1 + above)


def unigram_weight(types: np.ndarray, tokens: np.ndarray) -> float:
    """The weight a by leaving one token out, from the types and tokens of each bin of known words."""
    n, c = tokens.sum(), tokens / types
    return learn_weight((c - 1) / max(1, n - 1) * (types.sum() + 1), tokens) if n else 0.0


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts for each block's slice of one key range, and the range's part of the totals."""
    out = []
    for order, rows in pdf.groupby("order"):
        keys = [unpack_sorted(k) for k in rows["keys"]]
        own = np.concatenate([_unplanes(c, 4) for c in rows["own"]])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=own).astype(np.int64)
        counts = total[inverse].astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        for block, s, e in zip(rows["block"], ends - [len(k) for k in keys], ends):
            out.append((block, int(rows["range"].iloc[0]), int(order), _planes(counts[s:e]), None))
        if order == 1:
            bins, place, types = np.unique(count_bins(total), return_inverse=True, return_counts=True)
            tokens = np.bincount(place, weights=total).astype(np.int64)
            out.append((None, int(rows["range"].iloc[0]), 0, b"", list(zip(bins.tolist(), types.tolist(), tokens.tolist()))))
    table = pd.DataFrame(out, columns=["block", "range", "order", "counts", "totals"])
    table["totals"] = [None if t is None else [{"bin": c, "types": a, "tokens": b} for c, a, b in t] for t in table["totals"]]
    return table


_ANSWER_SCHEMA = "block string, range int, order int, counts binary, totals array<struct<bin long, types long, tokens long>>"


@dataclass(frozen=True)
class Interpolation:
    """Totals and mixture weights."""

    tokens: int
    types: int
    unigram: float
    bigram: np.ndarray  # per bucket of the context's count

    def p1(self, c: np.ndarray, tokens: int | None = None) -> np.ndarray:
        n = self.tokens if tokens is None else tokens
        return self.unigram * c / max(1, n) + (1 - self.unigram) / (self.types + 1)

    def probability(self, c_pair: np.ndarray, c_context: np.ndarray, c_word: np.ndarray) -> np.ndarray:
        weight = np.where(c_context > 0, self.bigram[bucket(c_context)], 0.0)
        return weight * c_pair / np.maximum(1, c_context) + (1 - weight) * self.p1(c_word)


def bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1)


def learn_weight(ratio: np.ndarray, n: np.ndarray, start: float = 0.5, steps: int = 100) -> float:
    """EM for p = w f + (1 - w) g on ``n`` held-out tokens with f / g = ``ratio``."""
    if not n.sum():
        return start
    w = start
    for _ in range(steps):
        new = float((n * (w * ratio / (w * ratio + 1 - w))).sum() / n.sum())
        new = min(max(new, 1e-6), 1 - 1e-6)
        if abs(new - w) < 1e-9:
            break
        w = new
    return w


def _meet(row: pd.Series, answers: pd.DataFrame) -> tuple[_Opened, np.ndarray, np.ndarray]:
    block = _Opened.of(row)
    counts = []
    for order in (1, 2):
        mine = answers[answers["order"] == order].sort_values("range")
        counts.append(np.concatenate([_unplanes(c, 8) for c in mine["counts"]]).astype(np.int64))
    return block, counts[0], counts[1]


def _held_out_ratios(model: Interpolation):
    """Histogram of log(f(w | v) / P1(w)) per bucket over a block whose own counts are deleted."""

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in blocks.iterrows():
            block, c1, c2 = _meet(row, answers)
            own1, own2 = block.own_counts()
            rest1, rest2 = c1 - own1, c2 - own2
            context = rest1[block.context]
            kept = context > 0
            f = rest2[block.pair][kept] / context[kept]
            ratio = f / model.p1(rest1[block.word][kept], model.tokens - int(own1.sum()))
            bins = np.where(ratio > 0, np.round(np.log(np.maximum(ratio, 1e-300)) / RATIO_STEP), -(10**6)).astype(np.int64)
            out.append(pd.DataFrame({"bucket": bucket(context[kept]), "bin": bins}).value_counts().rename("n").reset_index())
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["bucket", "bin", "n"])

    return run


def _score(model: Interpolation):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in blocks.iterrows():
            block, c1, c2 = _meet(row, answers)
            c_word, c_context, c_pair = c1[block.word], c1[block.context], c2[block.pair]
            starts = np.cumsum(block.sizes) - block.sizes
            base = np.log10((c_word + 1) / (model.tokens + model.types + 1))
            score = np.log10(model.probability(c_pair, c_context, c_word))
            out.append(
                pd.DataFrame(
                    {
                        "id": list(row["ids"]),
                        "held_out": block.folds == TEST_FOLD,
                        "n_tokens": block.sizes,
                        "n_known": np.add.reduceat((c_word > 0).astype(np.int64), starts),
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(score, starts),
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    return run


def interpolated_scores(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the words and one end token. Defined
    cases: a null or empty text is its end token alone; a null id is in the fold
    of the empty id text; rows that repeat an id are scored (and, in training
    folds, counted) each; without training rows every token has probability 1
    under both formulas; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), crc_fold(FOLDS).cast("int").alias("fold"), whole_text().alias("text"))
    blocks = cut_lineage(rows.mapInPandas(_encode(block_chars), _BLOCK_SCHEMA), "lm-blocks")
    n_tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    ranges = max(parallelism(spark), -(-n_tokens // RANGE_TOKENS))
    asked = blocks.mapInPandas(_requests(ranges), "range int, order int, block string, keys binary, own binary")
    answers = cut_lineage(asked.groupBy("range").applyInPandas(_answers, _ANSWER_SCHEMA), "lm-answers")

    totals = (
        answers.where("order = 0")
        .select(F.explode("totals").alias("t"))
        .groupBy("t.bin")
        .agg(F.sum("t.types").alias("types"), F.sum("t.tokens").alias("tokens"))
        .collect()
    )
    known = sorted((r["bin"], r["types"], r["tokens"]) for r in totals if r["bin"] > 0)
    tokens, types = sum(n for _, _, n in known), sum(n for _, n, _ in known)
    unigram = unigram_weight(*(np.array([k[i] for k in known], dtype=np.float64) for i in (1, 2)))
    model = Interpolation(tokens, types, unigram, np.zeros(BUCKETS))

    replies = answers.where("order > 0").select("block", "range", "order", "counts")
    held = blocks.where("weigh")
    mine = replies.join(held.select("block"), "block", "left_semi")
    bins = (
        held.groupBy("block")
        .cogroup(mine.groupBy("block"))
        .applyInPandas(_held_out_ratios(model), "bucket int, bin int, n long")
        .groupBy("bucket", "bin")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    hist = pd.DataFrame([r.asDict() for r in bins], columns=["bucket", "bin", "n"])
    hist["ratio"] = np.where(hist["bin"] > -(10**6), np.exp(hist["bin"].astype(float) * RATIO_STEP), 0.0)
    pooled = learn_weight(hist["ratio"].to_numpy(), hist["n"].to_numpy(dtype=float))
    bigram = np.full(BUCKETS, pooled)
    for b, part in hist.groupby("bucket"):
        bigram[int(b)] = learn_weight(part["ratio"].to_numpy(), part["n"].to_numpy(dtype=float), pooled)
    model = Interpolation(tokens, types, unigram, bigram)

    scored = (
        blocks.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInPandas(_score(model), "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )
    doc_id = F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return scored.select(doc_id, "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
