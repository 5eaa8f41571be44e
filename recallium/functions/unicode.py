"""Functions that need tables of Unicode which the JVM's expressions don't offer: Arrow batches."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Fixed value: the share of changed characters above which a text counts as disguised.
MOST_CHANGED = 0.05


def deviates(text: str | None) -> bool:
    """Whether compatibility decomposition changes over 5 % of a text, place by place; null and
    empty texts don't change."""
    if not text or text.isascii():
        return False
    plain = unicodedata.normalize("NFKD", text)
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, plain))
    least = min(len(a), len(b))
    changed = int((a[:least] != b[:least]).sum()) + abs(len(plain) - len(text))
    return changed / len(text) > MOST_CHANGED


@cache
def _decomposed(threshold: float):
    layer, score = T.DECOMPOSED

    @F.pandas_udf("name string, score double")
    def last(found: pd.DataFrame, heads: pd.Series) -> pd.DataFrame:
        odd = (found["score"] == 0) & heads.map(deviates)
        name = found["name"].astype(object).where(~odd, layer if score >= threshold else None)
        return pd.DataFrame({"name": name, "score": found["score"].where(~odd, score)})

    return last


def injection(text: Column, threshold: float = T.INJECTION_THRESHOLD) -> Column:
    """(name, score) over all layers: the patterns, and then the decomposition of texts that none of
    them matches. Characters are code points. Patterns are tried once, as what they find goes through the last layer."""
    return _decomposed(threshold)(T.injection(text, threshold), F.substring(text, 1, T.INJECTION_HEAD))


def sanitized(text: Column, threshold: float = T.INJECTION_THRESHOLD) -> Column:
    """The text, or a marker in its place if it tries to take over an assistant."""
    return F.when(injection(text, threshold)["name"].isNotNull(), T.FILTERED).otherwise(text)
