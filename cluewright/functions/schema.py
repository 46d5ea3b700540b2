"""The schema contract of the base tables, header aliases, and alignment of loose files to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
BANK_FLOW = _table(date=_S, subject=_S, counterparty=_S, amount=_L)
CALLS = _table(date=_S, subject=_S, callee=_S, count=_L)
TENDERS = _table(project=_S, award_notice_date=_S, winner=_S, supervising_official=_S)
REGISTRY = _table(subject=_S, legal_rep=_S, status=_S, related_party=_S)
TRAJECTORY = _table(date=T.TimestampType(), subject=_S, place=_S)
OSINT = _table(subject=_S, public_info=_S)
TIPS = _table(content=_S)
FEATURES = _table(subject=_S, feature=_S, value=_S, version=_L)

# Header names of source files and the columns they stand for.
ALIASES = {
    "交易日期": "date", "日期": "date", "date": "date", "时间": "date", "通话时间": "date",
    "交易金额": "amount", "金额": "amount", "amount": "amount", "数目": "amount",
    "付款方": "subject", "付款人": "subject", "姓名": "subject", "name": "subject", "主体": "subject",
    "收款方": "counterparty", "对方": "counterparty", "对端": "counterparty", "callee": "counterparty", "收款人": "counterparty",
    "用途": "purpose", "摘要": "purpose", "remark": "purpose",
}
# Keywords of file names and the source type they tell.
TYPE_HINTS = {
    "流水": "bank_flow", "资金": "bank_flow", "财务": "bank_flow",
    "通话": "call_record", "通讯": "call_record",
    "中标": "bid_win", "招投标": "bid_win", "公告": "bid_win",
    "工商": "business", "企业": "business", "公司": "business",
    "轨迹": "location", "出行": "location", "位置": "location",
}
REQUIRED = {"bank_flow": ["subject", "amount", "date"], "call_record": ["subject", "counterparty"], "bid_win": ["项目", "公司"]}


def renamed(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Headers by alias. Where two headers mean the same, the first keeps the name and later ones their own."""
    taken, names = set(), []
    for c in df.columns:
        to = (aliases or ALIASES).get(c.strip(), c.strip())
        if to in taken:
            to = c.strip() if c.strip() not in taken else f"{c.strip()}_{len(names)}"
        taken.add(to)
        names.append(to)
    return df.toDF(*names)


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema, with typed nulls for those that df lacks."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def missing(df: DataFrame, source_type: str) -> list[str]:
    """Required columns that df lacks. A warning to report, not an error."""
    return [c for c in REQUIRED.get(source_type, []) if c not in df.columns]
