"""Table schemas, column defaults and domain checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.functions.time import ts_ntz

S, L, I, D, B, TS, SH = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampNTZType(),
    T.ShortType(),
)


def _st(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CONTRIBUTORS = _st(
    ("id", S, False),
    ("github_id", L, False),
    ("github_username", S, False),
    ("github_avatar_url", S, True),
    ("reputation_score", D, False),
    ("total_annotations", I, False),
    ("total_input_tokens", L, False),
    ("total_output_tokens", L, False),
    ("created_at", TS, False),
    ("last_seen_at", TS, False),
)
PAIRS = _st(
    ("id", S, False),
    ("query_text", S, False),
    ("doc_id", S, False),
    ("doc_text", S, False),
    ("source_dataset", S, False),
    ("retrieval_method", S, False),
    ("source_rank", I, True),
    ("status", S, False),
    ("required_annotations", I, False),
    ("created_at", TS, False),
)
BATCHES = _st(
    ("id", S, False),
    ("contributor_id", S, False),
    ("size", I, False),
    ("status", S, False),
    ("assigned_at", TS, False),
    ("expires_at", TS, False),
    ("completed_at", TS, True),
)
BATCH_PAIRS = _st(("batch_id", S, False), ("pair_id", S, False))
ANNOTATIONS = _st(
    ("id", S, False),
    ("pair_id", S, False),
    ("contributor_id", S, False),
    ("batch_id", S, False),
    ("label", SH, False),
    ("model_id", S, False),
    ("quantization", S, False),
    ("input_tokens", I, False),
    ("output_tokens", I, False),
    ("raw_response_hash", S, False),
    ("is_honeypot", B, False),
    ("created_at", TS, False),
)
HONEYPOTS = _st(("pair_id", S, False), ("known_label", SH, False), ("created_at", TS, False))

TABLES = {
    "contributors": CONTRIBUTORS,
    "pairs": PAIRS,
    "batches": BATCHES,
    "batch_pairs": BATCH_PAIRS,
    "annotations": ANNOTATIONS,
    "honeypots": HONEYPOTS,
}

# Column defaults of the storage schema ("now" = as_of).
DEFAULTS = {
    "contributors": {
        "reputation_score": 0.5,
        "total_annotations": 0,
        "total_input_tokens": 0,
        "total_output_tokens": 0,
        "created_at": "now",
        "last_seen_at": "now",
    },
    "pairs": {"status": "unlabeled", "required_annotations": 2, "created_at": "now"},
    "batches": {"status": "assigned", "assigned_at": "now"},
    "annotations": {"is_honeypot": False, "created_at": "now"},
    "honeypots": {"created_at": "now"},
}

# Allowed values of status columns and the label range.
PAIR_STATUS = ("unlabeled", "verified", "rejected")
BATCH_STATUS = ("assigned", "completed", "expired")
LABEL_RANGE = (0, 3)


def with_defaults(df: DataFrame, table: str, as_of=None) -> DataFrame:
    """Fill missing or null columns with the table defaults and cast to the schema."""
    schema = TABLES[table]
    now = ts_ntz(as_of)
    cols = []
    for f in schema.fields:
        d = DEFAULTS.get(table, {}).get(f.name)
        default = None if d is None else (now if d == "now" else F.lit(d))
        if f.name in df.columns:
            c = F.col(f.name)
            if default is not None:
                c = F.coalesce(c, default)
        else:
            c = default if default is not None else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def rules(table: str) -> dict[str, Column]:
    """Named boolean checks (true = row is valid) for a table."""
    schema = TABLES[table]
    r: dict[str, Column] = {}
    for f in schema.fields:
        if not f.nullable:
            r[f"{f.name}_not_null"] = F.col(f.name).isNotNull()
    if table == "pairs":
        r["status_domain"] = F.col("status").isin(*PAIR_STATUS)
    if table == "batches":
        r["status_domain"] = F.col("status").isin(*BATCH_STATUS)
        r["size_range"] = F.col("size").between(1, 500)
    if table in ("annotations",):
        r["label_range"] = F.col("label").between(*LABEL_RANGE)
    if table == "honeypots":
        r["label_range"] = F.col("known_label").between(*LABEL_RANGE)
    return r


def validate(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows into ``(valid, violations)``; violations carry ``failed array<string>``.

    A null check result counts as failed.
    """
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]),
        lambda x: x.isNotNull(),
    )
    tagged = df.withColumn("failed", failed)
    return tagged.where(F.size("failed") == 0).drop("failed"), tagged.where(F.size("failed") > 0)
