"""Column-expression helpers (JVM-side, codegen friendly)."""

from labelforge.functions.families import KNOWN_FAMILIES, family_match, model_family
from labelforge.functions.ids import content_id, uuid5_url
from labelforge.functions.text import WHITESPACE_CLASS, tokenize
from labelforge.functions.vectors import fixed_point, l2_normalize

__all__ = [
    "KNOWN_FAMILIES",
    "WHITESPACE_CLASS",
    "content_id",
    "family_match",
    "fixed_point",
    "l2_normalize",
    "model_family",
    "tokenize",
    "uuid5_url",
]
