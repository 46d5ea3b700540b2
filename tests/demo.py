"""An invented case with known answers: five deposits near tender awards, one bridge, one busy pair of phones."""

from __future__ import annotations

import datetime

#: Project, day of its award, days until a deposit.
TENDERS = [("一号泵站", "2018-05-14", 4), ("河堤整修", "2019-01-22", 9), ("水厂扩建", "2019-09-30", 15), ("管道更新", "2020-07-08", 6), ("污水处理站", "2021-03-03", 11)]
DEPOSIT, WAGE_MONTHS, CALLS = 80_000, (2, 5, 8, 11), 90


def tables(spark):
    day = datetime.date.fromisoformat
    after = lambda d, n: day(d) + datetime.timedelta(days=n)
    wages = [(f"{year}-{month:02d}-12", "周启明", "水务局", 21_340 + month) for year in range(2018, 2022) for month in WAGE_MONTHS]
    deposits = [(str(after(d, n)), "周启明", "现金存入", DEPOSIT) for _, d, n in TENDERS]
    bridge = [("2020-08-01", "远图工程", "青石贸易", 3_200_000), ("2020-08-20", "青石贸易", "周启明之妹", 900_000)]
    calls = [(str(after("2020-01-03", 4 * i)), "周启明", "何志远", 1) for i in range(CALLS)]
    moves = [(after(d, 2), "周启明", f"{project}工地") for project, d, _ in TENDERS]
    registry = [("远图工程", "何志远", "存续", None), ("青石贸易", "何志远之舅", "存续", None), ("周启明之妹", None, "-", "周启明")]
    return {
        "flow": spark.createDataFrame(wages + deposits + bridge, "date string, subject string, counterparty string, amount long"),
        "calls": spark.createDataFrame(calls, "date string, subject string, callee string, count long"),
        "moves": spark.createDataFrame(moves, "date date, subject string, place string"),
        "registry": spark.createDataFrame(registry, "subject string, legal_rep string, status string, related_party string"),
        "tenders": spark.createDataFrame([(project, d) for project, d, _ in TENDERS], "project string, award_notice_date string"),
    }


HYPOTHESES = [
    ("H1", "中标后有来历不明的整数存款", ["银行流水", "言词证据"], ["银行流水", "招投标档案"], ["资金", "时间"], ["生间"]),
    ("H2", "供货方与主管人员有亲属关系", ["登记档案", "股权变更"], ["工商信息", "招投标档案"], ["关系"], ["因间"]),
    ("H3", "评标前后联系异常频繁", ["话单", "行程"], ["通话记录", "轨迹出行"], ["通讯", "行为"], ["生间"]),
    ("H4", "款项经第三家公司转出", ["完整账册"], ["银行流水", "工商信息"], ["资金", "时间"], ["反间"]),
]
SPACE = {
    "subject": ["周启明", "何志远", "青石贸易", "周启明之妹"],
    "behaviour": ["现金存入", "礼券", "转账", "过桥", "代持"],
    "time": ["开标前", "公示期", "完工后"],
    "amount": ["零散", "整笔"],
    "relation": ["本人", "他人"],
}
SUPPORTED = [("现金存入", "H1"), ("过桥", "H4")]


def theory(spark):
    from cluewright.operators.hypotheses import COLUMNS

    return spark.createDataFrame(HYPOTHESES, COLUMNS)
