"""Normal forms of person and organisation names.

All rules but NFKC are built-in expressions. Names that are plain ASCII need
no NFKC, and the others are normalised once per distinct name by callers, so
the one Python function sees few rows.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes of organisation names.
ORG_SUFFIXES = [
    "股份有限公司", "股份有限责任公司", "有限责任公司", "有限合伙", "普通合伙",
    "(集团)", "集团有限公司", "集团有限责任公司",
    "有限公司", "分公司", "子公司",
    "第一项目部", "第二项目部", "第三项目部", "项目部",
    "第一分公司", "第二分公司", "第三分公司",
    "北京分公司", "上海分公司", "广州分公司", "深圳分公司", "浙江分公司", "杭州分公司",
]
CJK = "[\\u4e00-\\u9fff]"


@F.pandas_udf(T.StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def nfkc(name: Column) -> Column:
    return _nfkc(name)


def _spaces(name: Column) -> Column:
    return F.when(name.rlike(CJK), F.regexp_replace(name, "\\s+", "")).otherwise(F.trim(F.regexp_replace(name, "\\s+", " ")))


def person_core(name: Column, unicode: bool = True) -> Column:
    """Comparable form: NFKC, no stray spaces, no notes in parentheses, lower case. Null becomes empty."""
    s = F.coalesce(name, F.lit(""))
    s = _spaces(nfkc(s) if unicode else s)
    return F.lower(F.regexp_replace(s, "[（(].*?[）)]", ""))


def org_core(name: Column, unicode: bool = True, suffixes: list[str] | None = None) -> Column:
    """Like person_core, after removing organisation suffixes wherever they stand, longest first."""
    s = F.coalesce(name, F.lit(""))
    s = _spaces(nfkc(s) if unicode else s)
    for suffix in sorted(suffixes or ORG_SUFFIXES, key=len, reverse=True):
        s = F.replace(s, F.lit(suffix), F.lit(""))
    return F.lower(F.regexp_replace(s, "[（(].*?[）)]", ""))


def attribute(value: Column, unicode: bool = True) -> Column:
    """Evidence values are compared in NFKC, trimmed and lower-cased; null becomes empty."""
    s = F.coalesce(value, F.lit(""))
    return F.lower(F.trim(nfkc(s) if unicode else s))


def entity_id(prefix: str, canonical: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.md5(canonical), 1, 10))
