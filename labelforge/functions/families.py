"""Model-family derivation used for judge-diversity steering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: family keywords, checked in this order.
KNOWN_FAMILIES = ("qwen", "mistral", "phi", "llama", "gemma", "deepseek")


def _basename(model_id: Column) -> Column:
    return F.regexp_replace(model_id, r"^.*/", "")


def model_family(model_id: Column | str) -> Column:
    """First keyword that starts a word in the lower-cased basename, else null.

    Null or empty ids give null. ``dolphin-2.9-llama3`` is llama, not phi.
    """
    c = F.col(model_id) if isinstance(model_id, str) else model_id
    base = F.lower(_basename(c))
    fam = F.coalesce(*[F.when(base.rlike(rf"(?U)\b{f}"), F.lit(f)) for f in KNOWN_FAMILIES])
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(fam)


def family_match(model_id: Column | str, family: Column | str) -> Column:
    """True when ``family`` starts a word in the basename (case-insensitive).

    Unlike ``model_family(x) == family`` this also matches a basename that names
    two families, e.g. a basename with both ``qwen`` and ``llama``.
    ``family`` may be a column (per-row family) or a literal string.
    """
    c = F.col(model_id) if isinstance(model_id, str) else model_id
    base = F.lower(_basename(c))
    if isinstance(family, str):
        return base.rlike(rf"(?U)\b{family}")
    return F.regexp_like(base, F.concat(F.lit(r"(?U)\b"), family))
