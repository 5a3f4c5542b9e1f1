import random

import pytest
from pyspark.sql import functions as F

from labelforge.llm import line_dedup as L
from tests.llm.data import ROWS, awkward, empty, from_texts


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(text, n, alphabet="abé"):
    text = list(text)
    for _ in range(n):
        k, how = random.randrange(len(text) + 1), random.random()
        if how < 0.35:
            text.insert(k, random.choice(alphabet))
        elif how < 0.7 and len(text) > 1:
            text.pop(min(k, len(text) - 1))
        elif text:
            text[min(k, len(text) - 1)] = random.choice(alphabet)
    return "".join(text)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_counts_and_stripping(spark, edits):
    random.seed(edits)
    rows = [("", "", 0), ("", "a", 1)]
    while len(rows) < 400:
        a = "".join(random.choice("abé") for _ in range(random.randint(1, 14)))
        a, b = sorted((a, mutated(a, random.randint(0, 5))), key=len)
        if len(b) - len(a) <= edits:
            rows.append((a, b, edit_distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, exact int")
    near = L.banded_edit_distance(F.col("a"), F.col("b"), edits)
    like = L.like_counts(L.character_counts(F.col("a")), L.character_counts(F.col("b")), F.lit(edits))
    df = df.select("*", near.alias("near"), like.alias("like"), L.stripped(F.col("a"), F.col("b")).alias("rest"))
    rest = L.banded_edit_distance(F.col("rest.a"), F.col("rest.b"), edits)
    for r in df.select("*", rest.alias("of_rest")).collect():
        assert (r.near == r.exact == r.of_rest) if r.exact <= edits else min(r.near, r.of_rest) > edits
        assert r.like or r.exact > edits
        a, b = r.a, r.b
        while a and b and a[0] == b[0]:
            a, b = a[1:], b[1:]
        while a and b and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        assert (r.rest.a, r.rest.b) == (a, b)


def brute(rows, edits=2, min_chars=20, near_chars=40):
    """Removed line numbers, near-removed ones, near links per doc_id, and near links."""
    first, lines = {}, {}
    for doc_id, text in rows:
        for no, raw in enumerate((text or "").split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if len(line) >= min_chars:
                place = (doc_id is None, doc_id, no)
                first[line] = min(first.get(line, place), place, key=lambda p: (p[0], p[1] or 0, p[2]))
                lines.setdefault((doc_id, no), set()).add(line)
    long = sorted((x for x in first if len(x) >= near_chars), key=len)
    order = lambda x: (first[x][0], first[x][1] or 0, first[x][2])
    late, links, ends = set(), 0, {}
    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            if len(b) - len(a) <= edits and edit_distance(a, b) <= edits:
                links += 1
                for x in (a, b):
                    ends[first[x][1]] = ends.get(first[x][1], 0) + 1
                late.add(max(a, b, key=order))
    kept = {(p[1], p[2]) for x, p in first.items() if x not in late}
    near = {(first[x][1], first[x][2]) for x in late}
    return {k for k in lines if k not in kept}, near, ends, links


def check(spark, df, rows, **options):
    gone, near, ends, links = brute(rows, **options)
    report = L.line_report(df).collect()
    assert len(report) == len(rows)
    exp = []
    for doc_id, text in rows:
        # rows that repeat an id are one document: a row has the removed numbers that it reaches
        lines = (text or "").split("\n")
        long = [n for n, x in enumerate(lines) if len(x.strip(" \t\r\x0b\x0c")) >= 20]
        removed = [n for n in long if (doc_id, n) in gone]
        late = [n for n in long if (doc_id, n) in near]
        exp.append((doc_id, len(lines), len(removed), len(late), ",".join(map(str, removed)), ends.get(doc_id, 0)))
    got = [(r.doc_id, r.n_lines, r.n_removed, r.n_near_removed, r.removed_lines, r.near_links) for r in report]
    assert sorted(got, key=str) == sorted(exp, key=str)
    left = {}
    for doc_id, text in rows:
        kept = [x for no, x in enumerate((text or "").split("\n")) if (doc_id, no) not in gone or len(x.strip(" \t\r\x0b\x0c")) < 20]
        left.setdefault(doc_id, []).append(None if text is None else "\n".join(kept))
    got = {}
    for r in L.dedup_lines(df).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in left.items()}
    return links


def test_awkward_rows_match_brute_force(spark):
    links = check(spark, awkward(spark), [(r[0], r[1]) for r in ROWS])
    assert links == 2  # PROSE and its copy with one edit, the second line and its misspelling


def test_columns_pass(spark):
    docs = awkward(spark)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {(r.score, r.label, r.fp, r.named, r.block) for r in out.collect()} == {("x", "y", "z", "n", "b")}
    for r in out.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_empty_table(spark):
    assert L.dedup_lines(empty(spark)).collect() == [] == L.line_report(empty(spark)).collect()


@pytest.mark.parametrize("hot", [16, 0])
def test_near_lines_match_all_pairs(spark, hot):
    """hot=0 sends every segment through the crowded path."""
    random.seed(11)
    base = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(38, 70))).strip() for _ in range(25)]
    lines = sorted({mutated(b, random.randint(0, 4), "abcdefgh ").strip() for b in base for _ in range(6)} | set(base))
    table = L.distinct_lines(from_texts(spark, ["\n".join(lines[:70]), "\n".join(lines[70:])]))
    got = {frozenset((r.a, r.b)) for r in L.near_lines(table, hot=hot).collect()}
    ids = {r.line: r.id for r in table.collect()}
    long = [x for x in ids if len(x) >= L.NEAR_CHARS]
    exp = {
        frozenset((ids[a], ids[b]))
        for i, a in enumerate(long)
        for b in long[i + 1 :]
        if abs(len(a) - len(b)) <= 2 and edit_distance(a, b) <= 2
    }
    assert got == exp and len(exp) > 20


def test_no_python_on_the_main_path(spark, capsys):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for out in (L.line_report(df), L.dedup_lines(df)):
        out.explain("formatted")
        plan = capsys.readouterr().out
        assert not any(k in plan for k in ("Python", "Pandas", "Arrow"))


LONGER = (*L.BANDS, (240, 8), (960, 16))  # the operator takes any bands


def allowed(n):
    return max(e for low, e in LONGER if n >= low)


def within(a, b, most):
    """The plain recurrence, on the diagonals that ``most`` edits can reach."""
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            up, left = row.get(j, most) + 1, new.get(j - 1, most) + 1
            new[j] = min(up, left, row.get(j - 1, most + 1) + (x != b[j - 1])) if j else i
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), most + 1) <= most


@pytest.mark.parametrize("letters, hot", [("abcdefgh ", 16), ("abcdefgh", 0)])  # with spaces and without any
def test_longer_lines_match_all_pairs_of_their_band(spark, letters, hot):
    random.seed(len(letters))
    line = lambda n: "".join(random.choice(letters) for _ in range(n)).replace(" ", "e", 1).strip()
    base = [line(n) for n in (109, 119, 120, 165, 239, 242, 480, 700, 959, 963, 1400)]
    lines = sorted({mutated(b, random.randint(0, allowed(len(b)) + 2), letters).strip() for b in base for _ in range(5)} | set(base))
    table = L.distinct_lines(from_texts(spark, ["\n".join(lines)]))
    ids = {r.line: r.id for r in table.collect()}
    got = {frozenset((r.a, r.b)) for r in L.near_lines(table, LONGER, hot=hot).collect()}
    long = sorted(ids, key=len)
    exp = {
        frozenset((ids[a], ids[b]))
        for i, a in enumerate(long)
        for b in long[i + 1 :]
        if len(b) - len(a) <= allowed(len(a)) and within(a, b, allowed(len(a)))
    }
    assert got == exp and len(exp) > 50


def test_one_replaced_word_makes_a_long_line_near(spark):
    words = [f"term{i * i}" for i in range(60)]
    line = " ".join(words)
    short = " ".join([*words[:30], "tired900", *words[31:]])
    other = " ".join([*words[:30], "replaced", *words[31:]])
    assert L.EDITS < edit_distance(line, short) <= 4 < edit_distance(line, other)
    for options, exp in (({}, {0: 0, 1: 1, 2: 0}), ({"bands": LONGER}, {0: 0, 1: 1, 2: 1})):
        got = {r.doc_id: r.n_near_removed for r in L.line_report(from_texts(spark, [line, short, other]), **options).collect()}
        assert got == exp


def test_a_cluster_of_near_lines_makes_no_row_per_pair(spark, monkeypatch):
    letters = "abcdefghijklmnop"
    lines = [f"a line of the cluster that differs {x}{y} in two letters at most from each other" for x in letters for y in letters]
    random.seed(5)
    random.shuffle(lines)
    df = from_texts(spark, ["\n".join(lines[:100]), "\n".join(lines[100:])])
    written, cut = [], L.cut_lineage

    def recorded(table, name):
        out = cut(table, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(L, "cut_lineage", recorded)
    for name, value in (("BLOCK_SEGMENTS", 1), ("PROBE_BLOCK", 24), ("STEP_LINES", 7)):
        monkeypatch.setattr(L, name, value, raising=False)  # several blocks and steps
    n = len(lines)
    report = {r.doc_id: r for r in L.line_report(df).collect()}
    ids = sorted(report)
    assert [report[i].near_links for i in ids] == [100 * (n - 1), (n - 100) * (n - 1)]
    assert [report[i].n_near_removed for i in ids] == [99, n - 100]
    assert "\n".join(r.text for r in L.dedup_lines(df).orderBy("doc_id").collect()).strip() == lines[0]
    assert max(written) <= 20 * n < n * (n - 1) // 2
