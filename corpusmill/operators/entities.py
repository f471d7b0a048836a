"""Entities of a text by rules: persons, times and topics, at most 16, in a fixed order, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 16
# Ideograph runs that are no person.
NOT_PERSONS = [
    "用户", "今日", "明天", "昨天", "早上", "晚上", "中午", "下午", "现在", "之前", "之后", "每天", "每周", "每月", "要求", "希望", "觉得", "应该", "已经", "可以", "不能",
    "不要", "不会", "请看", "请按", "请您", "想要", "开始", "结束", "完成", "进行", "继续", "停止", "暂停", "交易", "买入", "卖出", "购买", "使用", "看", "去", "来", "做了",
    "有了", "走了", "看了", "买了", "卖了", "用了", "当天", "当天买入", "当天卖出", "今天", "股票", "金额", "价格", "订单", "数量", "时间", "日期", "公司", "行业", "部门",
    "项目", "产品", "系统", "服务", "页面", "按钮", "表格", "图片", "视频", "文档", "数据", "客户", "对方", "本人", "自己", "大家", "他们", "我们", "你们", "她们", "它们",
    "这事", "那个", "这个", "哪个", "那些", "这些", "然后", "接着", "于是", "以后", "此时", "那时", "过去", "未来", "真的", "假的", "对的", "错的", "好的", "坏的", "贵的",
    "便宜", "高", "低", "大", "小", "多", "少", "长", "短",
]
# Characters before and after a run that make it a person.
BEFORE = ["在", "我", "他", "她", "这", "那", "叫", "对", "跟", "给"]
AFTER = ["是", "有", "在", "了", "说", "做", "叫", "来", "去", "的", "给", "跟", "向", "对", "和", "与", "们"]
# Capitalised words that are no person.
NOT_NAMES = [
    "The", "This", "That", "These", "Those", "I", "You", "We", "They", "He", "She", "It", "And", "But", "Or", "Not", "No", "Yes", "If", "When", "Where", "How", "Why",
    "What", "Who", "Then", "Now", "Here", "There", "Today", "Yesterday", "Tomorrow", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "API", "CEO", "CTO", "AI", "OK",
    "TODO", "URL", "USD", "USDC", "BTC", "ETH", "Post", "Pre", "Ship", "Fact", "User", "Admin", "Bus", "Note", "Class",
]
# Time patterns.
TIMES = [r"\b\d{4}-\d{1,2}(?:-\d{1,2})?\b", r"\b\d{4}年(?:\d{1,2}月)?(?:\d{1,2}日)?", "今天|昨天|明天|前天|后天|上周|本周|下周|上个月|这个月|下个月|今晚|明早|今早"]
QUOTED = "[\"“]([^\"”]{2,40})[\"”]"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the matches of a pattern, from 0 and in code points; words and digits of any script."""
    java = f"(?U){pattern}"
    pieces, hits = F.split(text, java, -1), F.regexp_extract_all(text, F.lit(java), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    zipped = F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))  # the last piece has no hit after it
    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(java), found).otherwise(none)


def _ideograph_persons(text: Column) -> Column:
    def person(x: Column) -> Column:
        before = F.when(x["start"] > 0, F.substr(text, x["start"], F.lit(1))).otherwise("")
        after = F.substr(text, x["end"] + 1, F.lit(1))
        dated = F.substring(x["hit"], 1, 1).isin("今", "明", "昨", "前", "后") & (F.length(x["hit"]) <= 3)
        return ~x["hit"].isin(NOT_PERSONS) & ~dated & (before.isin(*BEFORE, "的") | after.isin(AFTER))

    return F.transform(F.filter(spans(text, "[一-鿿]{2,4}"), person), lambda x: x["hit"])


def extract(text: Column, no_names: Iterable[str] = ()) -> Column:
    """array<struct<type, value>>: person (ideographs by context, then capitalised words), time, topic (tickers, quoted phrases).

    Equal values of a type in any case count once, the first 16 stay, values are cut at 128 characters. Null and blank texts
    have none. no_names are further capitalised words that are no person, such as the name of the caller's own system.
    """
    common = [*NOT_NAMES, *no_names]

    def every(pattern: str, group: int = 0) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(group))

    parts = [
        ("person", _ideograph_persons(text)),
        ("person", F.filter(every(r"\b[A-Z][a-zA-Z]{1,30}\b"), lambda w: ~w.isin(common))),
        *[("time", every(p)) for p in TIMES],
        ("topic", F.filter(every(r"\b[A-Z]{2,5}\b"), lambda w: ~w.isin(common))),
        ("topic", every(QUOTED, 1)),
    ]
    def of(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("type"), F.trim(v).alias("value"))

    named = [F.transform(values, of(kind)) for kind, values in parts]
    found = F.filter(F.flatten(F.array(*named)), lambda e: e["value"] != "")

    def step(acc: Column, e: Column) -> Column:
        key = F.concat(e["type"], F.lit("|"), F.lower(e["value"]))
        one = F.struct(e["type"].alias("type"), F.substring(e["value"], 1, 128).alias("value"))
        grown = F.struct(F.concat(acc["keys"], F.array(key)).alias("keys"), F.concat(acc["out"], F.array(one)).alias("out"))
        return F.when((F.size(acc["keys"]) >= MOST) | F.array_contains(acc["keys"], key), acc).otherwise(grown)

    none = F.array().cast("array<struct<type:string,value:string>>")
    short = F.aggregate(found, F.struct(F.array().cast("array<string>").alias("keys"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", none).otherwise(short)
