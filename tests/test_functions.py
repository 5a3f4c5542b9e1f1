import hashlib
import uuid

from pyspark.sql import functions as F

from labelforge.functions import content_id, family_match, model_family, tokenize, uuid5_url

TEXTS = ["Paris is the capital of France.", "", "héllo wörld — ünïcode ✓", "a　b c\x1cd e  f\tg\n"]


def test_content_id_matches_hashlib(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(content_id("t")).collect()]
    assert got == [hashlib.sha256(t.encode()).hexdigest()[:16] for t in TEXTS]


def test_uuid5_matches_python(spark):
    rows = [("test query 1", "doc1", "ds/squad"), ("é|x", "0123456789abcdef", "a/b"), ("", "", "")]
    df = spark.createDataFrame(rows, "q string, d string, s string")
    got = [r[0] for r in df.select(uuid5_url("q", "d", "s")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, f"{q}|{d}|{s}")) for q, d, s in rows]


def test_tokenize_matches_str_split(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(tokenize("t")).collect()]
    assert got == [t.lower().split() for t in TEXTS]


def test_tokenize_whole_unicode_whitespace(spark):
    ws = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    text = "x".join(ws) + "y"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokenize("t")).first()[0] == text.lower().split()


FAMILY_CASES = [
    ("Qwen/Qwen2.5-7B-Instruct-AWQ", "qwen"),
    ("mlx-community/Qwen2.5-7B-Instruct-4bit", "qwen"),
    ("mistralai/Mistral-7B-Instruct-v0.3", "mistral"),
    ("microsoft/Phi-3.5-mini-instruct", "phi"),
    ("some-org/UnknownNet-7B", None),
    (None, None),
    ("", None),
    ("dphn/dolphin-2.9-llama3-8b", "llama"),
    ("Qwen/Qwen2.5-7B-Instruct", "qwen"),
    ("meta-llama/Llama-3.1-8B-Instruct", "llama"),
    ("mistralai/SomethingElse-7B", None),
    ("google/gemma-2-9b-it", "gemma"),
]


def test_model_family_cases(spark):
    df = spark.createDataFrame(FAMILY_CASES, "m string, f string")
    got = df.select(model_family("m").alias("g"), "f").collect()
    assert [r.g for r in got] == [r.f for r in got]


def test_family_match_word_start(spark):
    df = spark.createDataFrame(
        [("dphn/dolphin-2.9-llama3-8b", "phi", False), ("x/qwen-llama-merge", "llama", True), ("x/QWEN2", "qwen", True)],
        "m string, fam string, want boolean",
    )
    rows = df.select(family_match(F.col("m"), F.col("fam")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)
    assert df.select(family_match("m", "llama")).collect()[1][0] is True
