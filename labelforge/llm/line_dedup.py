"""Line dedup by a segment-partition edit join (DataFrame functions only).

Lines equal after trimming are one distinct line. Two distinct lines of at least
``NEAR_CHARS`` characters are near if few single-character edits turn one into
the other: how many is set by the band of ``BANDS`` that the shorter one's length
is in. A band is cut into slices, and the first characters of a slice's lines,
as many as its shortest line has, into ``edits + 1`` segments at fixed places. A
near line holds one of them unchanged, shifted by at most as many characters as
segments stand before it. Of a segment, the characters from its first space on
are the key (from its start, if no space is near): so a line, which probes with
every shift, has few distinct keys. Index and probes meet in an equi-join of
hashes. A pair whose counts of single characters differ by more than the
threshold is dropped before any text is moved. The rest meet once with their
lines; what is between their common prefix and suffix is verified by a banded
bit-parallel edit distance, whose band of ``2 * edits + 1`` diagonals is one
machine word.

A segment of many lines makes no row per pair: its lines are gathered in blocks of
bounded size, block meets block, and a line gets its number of near lines from the
block that it met. A pair counts at the smallest of the crowded segments that it
shares, and there only.

A line is removed where an earlier line (by doc_id, then line number) is equal
or near. Lines below ``MIN_CHARS`` characters are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.common import store, whole_text
from labelforge.session import cut_lineage

#: Edits between near lines of the first band, at most.
EDITS = 2

#: Shorter lines are never removed.
MIN_CHARS = 20

#: Shorter lines are compared for equality only.
NEAR_CHARS = 40

#: (shortest line, edits): from this length of the shorter line on, near lines are so many edits apart at most.
BANDS = ((NEAR_CHARS, EDITS), (120, 4))

#: A slice of a band goes up to this multiple of its shortest line; the last one is open.
SLICE_GROWTH = 1.4
SLICES_ABOVE = 8

#: A segment's key begins at a space among its first characters: a third of it, and at most this many.
ANCHOR_CHARS = 12

#: Characters whose counts are compared before verification.
COUNTED = "etaoinshrdlucmfwypvbgkz., "

#: A segment of more lines than this is joined block by block.
HOT_SEGMENT = 16

#: Lines of a block, about, as a multiple of that, and their characters, about; lines that probe, per block.
BLOCK_SEGMENTS = 64
BLOCK_CHARS = 1_000_000
PROBE_BLOCK = 256

#: Lines of one step within a block: the bits of a word.
STEP_LINES = 64

#: Lines to look up below this number are broadcast (ids of eight bytes); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\u000b\f"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, not wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _segment(length: Column, number: Column, segments: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment of an even partition; the last ones take the remainder."""
    size = F.call_function("div", length, F.lit(segments)).cast("int")
    extra = length - size * segments
    before = F.greatest(F.lit(0), extra - (F.lit(segments) - number))
    own = F.when(F.lit(segments) - number <= extra, size + 1).otherwise(size)
    return size * number + before, own


def slices(bands: tuple[tuple[int, int], ...] = BANDS) -> list[tuple[int, int]]:
    """(shortest line, edits) of every slice, in order of length."""
    out = []
    for number, (low, edits) in enumerate(bands):
        low = max(low, edits + 1)
        end = bands[number + 1][0] if number + 1 < len(bands) else int(low * SLICE_GROWTH**SLICES_ABOVE)
        while low < end:
            out.append((low, edits))
            low = max(low + 1, int(low * SLICE_GROWTH))
    return out


def _slice_of(length: Column, cuts: list[tuple[int, int]]) -> Column:
    """Number of the slice of a length; null below the first one."""
    number = F.lit(None).cast("int")
    for i, (low, _) in enumerate(cuts):
        number = F.when(length >= low, F.lit(i)).otherwise(number) if i == 0 else F.when(length < low, number).otherwise(F.lit(i))
    return number


def _of_slice(number: Column, values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number)


def _keys(lines: DataFrame, cuts: list[tuple[int, int]], shifted: bool) -> DataFrame:
    """(key, id, length): hashes of each line's segments in slice ``j``, at every possible shift or at none.

    If edits up to ``edits`` leave segment k the first that is untouched after
    exactly k edits, it stands in the longer line at most k to the right and at
    most min(k, edits - k) to the left.
    """
    edits = _of_slice(F.col("j"), [e for _, e in cuts])
    size = _of_slice(F.col("j"), [low // (e + 1) for low, e in cuts])
    room = _of_slice(F.col("j"), [min(ANCHOR_CHARS, low // (e + 1) // 3) if e > EDITS else 0 for low, e in cuts])
    sized = lines.select("id", "line", "length", "j", edits.alias("edits"), size.alias("size"), room.alias("room"))
    each = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("k"))
    k, size, room, start = F.col("k"), F.col("size"), F.col("room"), F.col("k") * F.col("size")
    left = F.least(k, F.col("edits") - k, start) if shifted else F.lit(0)
    last = F.least(start + (k if shifted else F.lit(0)), F.col("length") - size)
    part = F.substring(F.col("line"), start - left + 1, last - (start - left) + size)
    each = each.select("id", "length", "j", "k", "size", "room", part.alias("part"), (last - (start - left)).alias("shifts"))

    def anchored(shift: Column) -> Column:
        space = F.call_function("locate", F.lit(" "), F.col("part"), shift + 1)
        return _let(space, lambda at: F.when(at.between(shift + 1, shift + 1 + F.col("room")), at - 1).otherwise(shift))

    shifts = F.sequence(F.lit(0), F.col("shifts"))
    starts = F.when(F.col("room") > 0, F.array_distinct(F.transform(shifts, anchored))).otherwise(shifts)
    found = each.where("shifts >= 0").select("*", F.explode(starts).alias("at"))
    text = F.substring(F.col("part"), F.col("at") + 1, F.col("size") - F.col("room"))
    return found.select(F.xxhash64("j", "k", text).alias("key"), "id", "length")


def index_keys(lines: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """(key, a, na): the segments of ``lines(id, line, length)``, each line in the slice of its length."""
    cuts = slices(bands)
    keys = _keys(lines.select("id", "line", "length", _slice_of(F.col("length"), cuts).alias("j")), cuts, False)
    return keys.select("key", F.col("id").alias("a"), F.col("length").alias("na"))


def probe_keys(lines: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS) -> DataFrame:
    """(key, b, nb): what a line may hold of the segments of lines no longer than itself, in every slice in reach."""
    cuts = slices(bands)
    own = _slice_of(F.col("length"), cuts)
    # a slice in reach below: its longest line is at most its edits shorter
    reach = [F.when((own > i) & (F.col("length") - edits < cuts[i + 1][0]), F.lit(i)) for i, (_, edits) in enumerate(cuts[:-1])]
    places = F.array_compact(F.array(own, *reach))
    keys = _keys(lines.select("id", "line", "length", F.explode(places).alias("j")), cuts, True)
    return keys.select("key", F.col("id").alias("b"), F.col("length").alias("nb"))


def allowed_edits(length: Column, bands: tuple[tuple[int, int], ...] = BANDS) -> Column:
    """Edits of the band of the shorter line's length."""
    edits = F.lit(bands[0][1])
    for low, more in bands[1:]:
        edits = F.when(length >= low, F.lit(more)).otherwise(edits)
    return edits


def _by_band(length: Column, bands: tuple[tuple[int, int], ...], body: Callable[[int], Column]) -> Column:
    """``body(edits)`` with the edits of the band of a length."""
    out = body(bands[0][1])
    for low, edits in bands[1:]:
        out = F.when(length >= low, body(edits)).otherwise(out)
    return out


def character_counts(line: Column) -> Column:
    """Occurrences of each of ``COUNTED`` in a line."""
    size = F.octet_length(line)
    return F.array(*[size - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED])


def like_counts(a: Column, b: Column, edits: Column) -> Column:
    """False only for lines beyond the threshold: an edit takes one character away, or adds one, or both."""
    more = F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0))), F.lit(0), lambda s, x: s + x)
    less = F.aggregate(F.zip_with(b, a, lambda x, y: F.greatest(x - y, F.lit(0))), F.lit(0), lambda s, x: s + x)
    return (more <= edits) & (less <= edits)


def _common(size: Column, same: Callable[[Column, Column], Column]) -> Column:
    """The greatest p up to ``size`` for which ``same(start, length)`` holds of all up to p, by halving steps."""

    def step(p: Column, bit: Column) -> Column:
        more = F.call_function("shiftleft", F.lit(1), bit)
        return F.when((p + more <= size) & same(p, more), p + more).otherwise(p)

    bits = F.sequence(F.ceil(F.log2(size + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))
    return F.when(size <= 0, F.lit(0)).otherwise(F.aggregate(bits, F.lit(0), step))


def stripped(a: Column, b: Column) -> Column:
    """Struct (a, b) of what is left of two lines without their common prefix and, then, suffix."""

    def without_suffix(x: Column) -> Column:
        left, right = x["a"], x["b"]
        na, nb = F.char_length(left), F.char_length(right)
        suffix = _common(
            F.least(na, nb),
            lambda q, n: F.substring(left, na - q - n + 1, n) == F.substring(right, nb - q - n + 1, n),
        )
        return _let(suffix, lambda q: F.struct(F.substring(left, F.lit(1), na - q).alias("a"), F.substring(right, F.lit(1), nb - q).alias("b")))

    prefix = _common(F.least(F.char_length(a), F.char_length(b)), lambda p, n: F.substring(a, p + 1, n) == F.substring(b, p + 1, n))
    rest = _let(prefix, lambda p: F.struct(F.substring(a, p + 1, F.char_length(a)).alias("a"), F.substring(b, p + 1, F.char_length(b)).alias("b")))
    return _let(rest, without_suffix)


def banded_edit_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of ``a`` and the at most ``edits`` characters longer ``b``; above ``edits`` only "more" is meant.

    Bits of a word are the rows of the band around the diagonal. VP and VN mark
    the rows whose value rises or falls against the row above; D0 marks those
    equal to their diagonal neighbour, and the bit on the diagonal of the last
    cell counts the distance.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    falling = (1 << edits) - 1  # before the first column: rows above the first character fall, the others rise

    def step(pair: Column, state: Column, j: Column) -> Column:
        left, right, lag = pair["left"], pair["right"], pair["lag"]
        vp, vn = state["vp"], state["vn"]
        matches = [
            F.when(F.get(left, j - F.lit(edits - i)) == F.get(right, j), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            for i in range(width)
        ]
        pm = sum(matches[1:], matches[0])

        def with_pm(m: Column) -> Column:
            return ((m.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(mask))

        def with_d0(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)))
            hn = d0.bitwiseAND(vp)
            down = F.shiftright(d0, 1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(mask)).alias("vp"),
                down.bitwiseAND(hp).bitwiseAND(F.lit(mask)).alias("vn"),
                (state["d"] + F.lit(1) - F.call_function("shiftright", d0, F.lit(edits) - lag).bitwiseAND(F.lit(1))).cast("int").alias("d"),
            )

        return F.when(state["d"] > edits, state).otherwise(_let(_let(pm, with_pm), with_d0))

    def whole(pair: Column) -> Column:
        start = F.struct(F.lit(mask ^ falling).cast("long").alias("vp"), F.lit(falling).cast("long").alias("vn"), pair["lag"].alias("d"))
        columns = F.sequence(F.lit(0), F.size(pair["right"]) - 1)
        return F.aggregate(columns, start, lambda state, j: step(pair, state, j), lambda state: state["d"])

    pair = F.struct(
        F.split(a, "").alias("left"), F.split(b, "").alias("right"), (F.char_length(b) - F.char_length(a)).alias("lag")
    )
    return F.when(F.char_length(b) == 0, F.lit(0)).otherwise(_let(pair, whole))


def distinct_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, line, length, first, rows): every distinct trimmed line and its first place (doc_id, line number)."""
    places = docs.select("doc_id", F.posexplode(split_lines(whole_text())).alias("line_no", "raw"))
    lines = places.select("doc_id", "line_no", trimmed(F.col("raw")).alias("line")).where(
        F.char_length("line") >= min_chars
    )
    # null ids come last: a struct orders nulls first
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    found = lines.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("rows"))
    return store(
        found.select(F.monotonically_increasing_id().alias("id"), "line", F.char_length("line").alias("length"), "first", "rows"),
        "distinct-lines",
    )


def _within(a: Column, b: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """Whether line ``a``, no longer than ``b``, is within its band's edits of it."""
    return _let(
        stripped(a["line"], b["line"]),
        lambda rest: _by_band(a["n"], bands, lambda edits: banded_edit_distance(rest["a"], rest["b"], edits) <= edits),
    )


def _like(a: Column, b: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """Whether a pair is to be compared in this order and may be near by lengths and character counts."""
    edits = allowed_edits(a["n"], bands)
    ordered = (a["n"] < b["n"]) | ((a["n"] == b["n"]) & (a["id"] < b["id"]))
    return ordered & (b["n"] - a["n"] <= edits) & like_counts(a["c"], b["c"], edits)


def _candidates(lines: DataFrame, bands: tuple[tuple[int, int], ...], hot: int) -> tuple[DataFrame, DataFrame]:
    """(pairs that share a segment of few lines, the lines of all candidates).

    Pairs: (a, b). Lines: (id, line, n, first, c, indexed, probed); the arrays name
    the crowded segments that a line is in or looks into, with their numbers of blocks.
    """
    long = lines.where(F.col("length") >= slices(bands)[0][0]).select("id", "line", "length", "first")
    index, probe = cut_lineage(index_keys(long, bands), "segment-index"), probe_keys(long, bands)
    once = F.expr("a <> b and (na < nb or (na = nb and a < b))") & (F.col("nb") - F.col("na") <= allowed_edits(F.col("na"), bands))

    def blocks(of: Column, most: int) -> Column:
        return F.ceil(F.greatest(F.count("*") / most, F.sum(of) / BLOCK_CHARS)).cast("int")

    counted = index.groupBy("key").agg(F.count("*").alias("n"), blocks(F.col("na"), BLOCK_SEGMENTS * max(1, hot)).alias("parts"))
    crowded = cut_lineage(counted.where(F.col("n") > hot).select("key", "parts"), "crowded-segments")
    # one pass of the probes: crowded segments are met by their key alone, the others by their lines
    sought = index.join(crowded, "key", "left_anti").select("key", "a", "na")
    sought = sought.union(crowded.select("key", F.lit(None).cast("long"), F.lit(None).cast("int")))
    met = sought.join(probe, "key").where(F.col("a").isNull() | once).select("key", "a", "b", F.when(F.col("a").isNull(), F.col("nb")).alias("nb"))
    met = cut_lineage(met, "segment-matches")
    cold = met.where("a is not null").select("a", "b").distinct()
    hot_probe = met.where("a is null").select("key", "b", "nb")
    sizes = cut_lineage(hot_probe.groupBy("key").agg(blocks(F.col("nb"), PROBE_BLOCK).alias("blocks")).join(crowded, "key"), "segment-blocks")
    hots = (
        index.join(sizes, "key").select(F.col("a").alias("id"), F.struct("key", "parts").alias("i"), F.lit(None).alias("p"))
        .unionByName(hot_probe.join(sizes, "key").select(F.col("b").alias("id"), F.lit(None).alias("i"), F.struct("key", "parts", "blocks").alias("p")))
        .groupBy("id")
        .agg(F.collect_set("i").alias("indexed"), F.collect_set("p").alias("probed"))
    )
    hots = cut_lineage(hots, "crowded-lines")
    ids = cut_lineage(cold.select(F.col("a").alias("id")).union(cold.select("b")).union(hots.select("id")).distinct(), "candidate-lines")
    few = ids.count() <= BROADCAST_IDS
    texts = long.join(F.broadcast(ids) if few else ids, "id", "left_semi").join(hots, "id", "left")
    texts = texts.select("id", "line", F.col("length").alias("n"), "first", character_counts(F.col("line")).alias("c"), "indexed", "probed")
    return cold, store(texts, "candidate-texts")


def _cold_links(cold: DataFrame, texts: DataFrame, bands: tuple[tuple[int, int], ...]) -> DataFrame:
    """(a, b, before): the near pairs without a common crowded segment; whether b's place is the earlier one."""

    def side(name: str, keys: str, *columns: str) -> DataFrame:
        return texts.select(F.col("id").alias(name), F.struct("id", *columns, F.col(keys)["key"].alias("keys")).alias(f"of_{name}"))

    a, b = F.col("of_a"), F.col("of_b")
    apart = ~F.coalesce(F.arrays_overlap(a["keys"], b["keys"]), F.lit(False))
    like = cold.join(side("a", "indexed", "n", "c"), "a").join(side("b", "probed", "n", "c"), "b").where(_like(a, b, bands) & apart)
    like = cut_lineage(like.select("a", "b"), "like-lines")
    whole = like.join(side("a", "indexed", "n", "line", "first"), "a").join(side("b", "probed", "n", "line", "first"), "b")
    return whole.where(_within(a, b, bands)).select("a", "b", (b["first"] < a["first"]).alias("before"))


def _blocks(texts: DataFrame) -> DataFrame:
    """(key, mine, theirs): every block of a crowded segment's lines with every block of the lines that look into it."""

    def gathered(keys: str, number: str) -> DataFrame:
        each = texts.select("*", F.explode(keys).alias("at"))
        line = F.struct("id", "line", "n", "first", "c", F.col(keys)["key"].alias("keys"))
        rows = each.select(F.col("at.key").alias("key"), F.col("at.parts").alias("parts"), F.pmod(F.xxhash64("id"), F.col(f"at.{number}")).cast("int").alias("block"), line.alias("line"))
        return rows.groupBy("key", "parts", "block").agg(F.collect_list("line").alias("lines"))

    mine = gathered("indexed", "parts").select("key", F.col("block").alias("part"), F.col("lines").alias("mine"))
    theirs = gathered("probed", "blocks").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lines").alias("theirs"))
    return mine.join(theirs, ["key", "part"]).select("key", "mine", "theirs")


def _by_steps(body: Callable[[Column], Column]) -> Column:
    """The arrays that ``body`` makes of each step of ``mine``, as one."""
    starts = F.sequence(F.lit(1), F.size("mine"), F.lit(STEP_LINES))
    return F.flatten(F.transform(starts, lambda at: _let(F.slice("mine", at, STEP_LINES), body)))


def _hits(some: Column, b: Column, bands: tuple[tuple[int, int], ...]) -> Column:
    """Places in ``some`` of the lines near ``b`` whose smallest common crowded segment this is."""

    def here(a: Column) -> Column:
        return _like(a, b, bands) & (F.array_min(F.array_intersect(a["keys"], b["keys"])) == F.col("key")) & _within(a, b, bands)

    return F.array_compact(F.transform(some, lambda a, i: F.when(here(a), i)))


def _bits(places: Column) -> Column:
    return F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def _counted_ends(bands: tuple[tuple[int, int], ...]) -> Column:
    """(id, links, late) of the lines of two blocks that have near lines in the other one."""

    def step(some: Column) -> Column:
        def row(b: Column) -> Column:
            return _let(
                _hits(some, b, bands),
                lambda hits: F.struct(b["id"].alias("id"), _bits(hits).alias("near"), _bits(F.filter(hits, lambda i: F.get(some, i)["first"] < b["first"])).alias("before")),
            )

        def both(rows: Column) -> Column:
            def own(a: Column, i: Column) -> Column:
                bit = lambda word: F.call_function("shiftright", word, i).bitwiseAND(F.lit(1).cast("long"))
                return F.struct(
                    a["id"].alias("id"),
                    F.aggregate(rows, F.lit(0).cast("long"), lambda s, r: s + bit(r["near"])).alias("links"),
                    F.exists(rows, lambda r: bit(r["near"].bitwiseXOR(r["before"])) == 1).alias("late"),
                )

            other = F.transform(rows, lambda r: F.struct(r["id"].alias("id"), F.bit_count(r["near"]).cast("long").alias("links"), (r["before"] != 0).alias("late")))
            return F.when(F.size(rows) > 0, F.concat(other, F.filter(F.transform(some, own), lambda e: e["links"] > 0))).otherwise(other)

        return _let(F.filter(F.transform("theirs", row), lambda r: r["near"] != 0), both)

    return _by_steps(step)


def _late_ends(bands: tuple[tuple[int, int], ...]) -> Column:
    """(id, links, late) of the lines of two blocks that have an earlier near line in the other one; links are not counted."""
    marked = lambda x: F.struct(x["id"].alias("id"), F.lit(None).cast("long").alias("links"), F.lit(True).alias("late"))
    near = lambda a, b: _like(a, b, bands) & _within(a, b, bands)
    mine = F.filter("mine", lambda a: F.exists("theirs", lambda b: (b["first"] < a["first"]) & near(a, b)))
    theirs = F.filter("theirs", lambda b: F.exists("mine", lambda a: (a["first"] < b["first"]) & near(a, b)))
    return F.concat(F.transform(mine, marked), F.transform(theirs, marked))


def near_lines(lines: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS, hot: int = HOT_SEGMENT) -> DataFrame:
    """(a, b): ids of the distinct lines within the edits of a's band, a's line no longer than b's; every pair once."""
    cold, texts = _candidates(lines.select("id", "line", "length", F.col("id").alias("first")), bands, hot)

    def step(some: Column) -> Column:
        ends = lambda b: F.transform(_hits(some, b, bands), lambda i: F.struct(F.get(some, i)["id"].alias("a"), b["id"].alias("b")))
        return F.flatten(F.transform("theirs", ends))

    crowded = _blocks(texts).select(F.explode(_by_steps(step)).alias("pair")).select("pair.a", "pair.b")
    return cut_lineage(_cold_links(cold, texts, bands).select("a", "b").union(crowded), "near-lines")


def line_links(
    lines: DataFrame, bands: tuple[tuple[int, int], ...] = BANDS, hot: int = HOT_SEGMENT, counted: bool = True
) -> DataFrame:
    """(id, links, late) of the lines that have near ones: their number, and whether one has an earlier place.

    Without ``counted`` a line is done with a block at the first earlier near line: ``late`` alone is meant.
    """
    cold, texts = _candidates(lines, bands, hot)
    end = lambda name, late: F.struct(F.col(name).alias("id"), F.lit(1).cast("long").alias("links"), late.alias("late"))
    few = _cold_links(cold, texts, bands).select(F.explode(F.array(end("a", F.col("before")), end("b", ~F.col("before")))).alias("end"))
    many = _blocks(texts).select(F.explode(_counted_ends(bands) if counted else _late_ends(bands)).alias("end"))
    ends = few.union(many).select("end.id", "end.links", "end.late")
    return cut_lineage(ends.groupBy("id").agg(F.sum("links").alias("links"), F.max("late").alias("late")), "line-links")


def line_decisions(
    docs: DataFrame, min_chars: int = MIN_CHARS, bands: tuple[tuple[int, int], ...] = BANDS, counted: bool = True
) -> DataFrame:
    """(doc_id, kept_lines, near_removed, near_links): line numbers per document that holds a first place.

    ``kept_lines`` are first places that stay, ``near_removed`` first places that
    have an earlier near line, ``near_links`` counts the near lines of both (not
    there without ``counted``).
    """
    lines = distinct_lines(docs, min_chars)
    linked = line_links(lines, bands, counted=counted)
    place = lines.select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))
    marked = place.join(linked, "id", "left")
    late = F.coalesce("late", F.lit(False))
    found = marked.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(~late, F.col("line_no")))).alias("kept_lines"),
        F.array_sort(F.collect_list(F.when(late, F.col("line_no")))).alias("near_removed"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("near_links"),
    )
    return found if counted else found.drop("near_links")


def _eligible(text: Column, min_chars: int) -> Column:
    """Numbers of the lines that are long enough to be removed."""
    marked = F.transform(split_lines(text), lambda x, i: F.when(F.char_length(trimmed(x)) >= min_chars, i))
    return F.filter(marked, lambda i: i.isNotNull())


def _numbers(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<int>"))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, **options) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, n_near_removed, removed_lines, near_links.

    Texts are not moved: only line numbers meet. The defined cases are those of
    ``dedup_lines``.
    """
    choices = line_decisions(docs, min_chars=min_chars, **options).withColumnRenamed("doc_id", "of")
    text = whole_text()
    lines = docs.select(
        "doc_id", F.size(split_lines(text)).cast("long").alias("n_lines"), _eligible(text, min_chars).alias("eligible")
    )
    joined = lines.join(choices, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    removed = F.array_sort(F.array_except("eligible", _numbers("kept_lines")))
    near = F.array_intersect("eligible", _numbers("near_removed"))
    return joined.select(
        "doc_id",
        "n_lines",
        F.size(removed).cast("long").alias("n_removed"),
        F.size(near).cast("long").alias("n_near_removed"),
        F.concat_ws(",", removed.cast("array<string>")).alias("removed_lines"),
        F.coalesce("near_links", F.lit(0)).cast("long").alias("near_links"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, **options) -> DataFrame:
    """``docs`` with the removed lines cut from ``text`` and ``n_chars``, if there, set anew.

    Defined cases: a null text stays null; a text that loses every line becomes
    empty; rows that repeat an id are one document whose kept line numbers hold
    for each of them; null ids come after all others and are one document; lines
    are trimmed of blanks for comparison only; extra columns pass unchanged,
    whatever their names; an empty table gives no rows.
    """
    choices = line_decisions(docs, min_chars=min_chars, counted=False, **options).select(F.col("doc_id").alias("of"), "kept_lines")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("key"))
    joined = rows.join(choices, F.col("key").eqNullSafe(F.col("of")), "left")
    text = F.col("doc.text")
    removed = F.array_except(_eligible(text, min_chars), _numbers("kept_lines"))

    def without(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        gone = F.transform(removed, lambda i: F.struct(i.alias("i"), F.get(lines, i).alias("x")))
        return F.array_join(F.transform(F.array_except(numbered, gone), lambda t: t["x"]), "\n")

    left = _let(split_lines(text), without)
    out = joined.select("doc", F.when(F.size(removed) == 0, text).otherwise(left).alias("left"))
    changed = {"text": F.col("left"), "n_chars": F.char_length("left").cast("long")}
    return out.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
