"""Distilling: what a private note has to say to others, with a report.

Technical tokens (paths, addresses, versions, names in code) are set aside as constants before the text is cut into sentences, so
that no cut goes through one; sentences with private signals go, private values become placeholders, the constants
return, what still shows a signal goes too, and a text that keeps neither a method nor a constant is empty. Every step reads what
the one before wrote, so that a text is one task's work; texts are independent.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.operators import personal

# Ends of sentences, tokens that stay, placeholders and words of methods.
SENTENCE = re.compile(r"(?<=[。！？？！])\s*|(?<=[.!?])(?!\d)\s*|\n+|(?<=[一-鿿]),\s+(?=[一-鿿])|(?<=[一-鿿])，(?=[一-鿿])")
ENDINGS = "py|js|ts|tsx|jsx|java|go|rs|c|cpp|h|hpp|md|txt|json|yaml|yml|toml|sh|sql|html|htm|xml|csv|log|ini|cfg|conf|css"
FILE = re.compile(r"(?:<[^<>\s]{1,24}>)?(?:[A-Za-z]:[/\\])?(?:[/\\])?(?:\.[\w-]+|[\w][\w./\\-]*)?\.(?:" + ENDINGS + r")(?::\d{1,5})?(?=\b|[\s.,])")
RUN, ENDING = re.compile(r"\S+"), re.compile(rf"\.(?:{ENDINGS})")
CONSTANTS = [
    re.compile(r"(?<!\w)(?:<[^<>\s]{1,24}>)?/[a-zA-Z.][\w./\-]{2,200}"),
    re.compile(r"(?<![\w@./-])(?:[a-z0-9-]+\.)+[a-z]{2,24}(?![\w-])"),
    re.compile(r"\bv?\d+\.\d+\.\d+(?:[-+][\w.]+)?\b"),
    re.compile(r"\b(?:[1-5]\d{2})\b(?=\s+(?:status|code|error|response))", re.I),
    re.compile(r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*){1,3}\(\)"),
    re.compile(r"\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b"),
    re.compile(r"\b[0-9a-f]{8,}\b"),
    re.compile(r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", re.I),
    re.compile(r"\b\w{1,20}=\S+"),
]
PRIVATE_TOKEN = re.compile(r"\b(?:1[3-9]\d{9}|[\w.+-]+@[\w-]+\.[\w.-]+|\d{17}[\dXx]|\d{16,19}|\d{3}-\d{2}-\d{4}|o[A-Za-z0-9_-]{20,}@im\.wechat)\b")
ADDRESS = re.compile(r"https?://[^\s一-鿿]+")
DAY = re.compile(r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b")
DAY_WORDS = re.compile("今天|明天|昨天|前天|后天|今晚|今早|今晚上|上午|下午|中午|晚上|上周|本周|本月|上月|今年|去年|明年")
CITIES = ["Beijing", "Tokyo", "Shanghai", "NewYork", "New York", "Calgary", "Edmonton", "Toronto", "Vancouver", "Boston", "London", "Paris", "Berlin", "Singapore"]
CITIES += ["北京", "上海", "深圳", "广州", "杭州", "成都", "武汉", "东京", "大阪", "京都", "香港", "台北", "首尔", "济州"]
CITY = re.compile(r"\b(?:" + "|".join(map(re.escape, CITIES)) + r")\b")
METHOD = re.compile(
    r"\b(method|recipe|step|workflow|how[- ]to|first|then|next|finally|process|pattern|approach|technique|formula|tactic)\b|"
    r"(方法|步骤|流程|教程|方案|公式|战术|模板|先|再|然后|最后|首先|第三|创建|技巧|实战|最佳实践)"
)
STATE = re.compile(r"(\[[A-Za-z0-9_:.-]+\]=)([^,\n]+)")
MARK = "\n\n[STATE-CONST] "
KEPT = 20
BEFORE = 40


def constants(text: str) -> list[tuple[str, bool]]:
    """(token, private) of the different technical tokens, by rule and then by place; private if what stands before says so."""
    found: dict[str, bool] = {}

    def add(m: re.Match) -> None:
        if m[0] not in found:
            found[m[0]] = bool(personal.private_values(text[max(0, m.start() - BEFORE) : m.end()]))

    for run in RUN.finditer(text):  # a file name lies within a run of characters; runs without an ending cost one look
        if ENDING.search(run[0]):
            for m in FILE.finditer(text, run.start(), run.end()):
                add(m)
    for pattern in CONSTANTS:
        for m in pattern.finditer(text):
            add(m)
    return list(found.items())


def _swap(text: str, pairs: dict[str, str]) -> str:
    """Replace all keys by their values in one pass, longer keys first, so that nothing written is read again."""
    if not pairs:
        return text
    return re.sub("|".join(map(re.escape, sorted(pairs, key=len, reverse=True))), lambda m: pairs[m[0]], text)


def sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, SENTENCE.split(text)) if s]


def _placeholder(token: str) -> str:
    if "@" in token:
        return "[WECHAT_ID]" if token.endswith("@im.wechat") else "[EMAIL]"
    if "-" in token and len(token) == 11:
        return "[SSN]"
    if len(token) == 18:
        return "[ID_CARD]"
    if 16 <= len(token) <= 19:
        return "[BANK_CARD]"
    return "[PHONE]" if len(token) == 11 and token.startswith("1") else "[REDACTED]"


def _redacted(sentence: str) -> str:
    out = sentence
    for m in PRIVATE_TOKEN.finditer(sentence):
        out = out.replace(m[0], _placeholder(m[0]))
    return out


def _numbered(text: str, pattern: re.Pattern, name: str) -> str:
    """Matches become [name_1], [name_2] and so on."""
    count = iter(range(1, len(text) + 2))
    return pattern.sub(lambda m: f"[{name}_{next(count)}]", text)


def distill(text: str) -> tuple[str, list[tuple[str, str]], dict]:
    """(clean text, dropped (sentence, reason), report)."""
    if not text:
        return "", [], dict.fromkeys(REPORT, 0) | dict.fromkeys(FLAGS, False)
    tokens = constants(text)
    marks = {token: f"[STATE:{k}]" for k, (token, _) in enumerate(tokens, 1)}
    whole, dropped, kept = sentences(_swap(text, marks)), [], []
    for s in whole:
        reason = "first_person" if personal.first_person(s) else "emotion" if personal.EMOTION.search(s) else "geographic_personal" if personal.RESIDENCE.search(s) else None
        clean = _redacted(s) if reason is None else s
        if reason is None and clean.count("[") > 5 and len(clean) < 80:
            reason = "too_much_redaction"
        dropped.append((s, reason)) if reason else kept.append(clean)
    body = ADDRESS.sub("[URL]", " ".join(kept))
    body = _numbered(_numbered(_numbered(body, DAY, "DATE"), DAY_WORDS, "DATE"), CITY, "LOCATION")
    back, final = {mark: token for token, mark in marks.items()}, []
    for s in sentences(body):
        s = _swap(s, back)
        if personal.private_values(s) or personal.first_person(s) or personal.EMOTION.search(s):
            dropped.append((s, "residual_after_distill"))
        else:
            final.append(s)
    out = " ".join(final)
    if tokens:
        block = ", ".join(f"{marks[token]}={'[REDACTED]' if private else token}" for token, private in tokens[:KEPT])
        out = STATE.sub(lambda m: f"{m[1]}[REDACTED]" if personal.private_values(m[2]) else m[0], f"{out}{MARK}{block}".strip())
    method = METHOD.search(out)
    if not method and not tokens:
        out = ""
    report = {"sentences_in": len(whole), "sentences_out": len(final), "dropped_count": len(dropped), "state_const_count": len(tokens)}
    flags = {"has_pii_after": bool(out and personal.private_values(out)), "has_first_person_after": bool(out and personal.first_person(out)), "method_keywords_present": bool(out and method)}
    return out, dropped, report | flags


REPORT = ("sentences_in", "sentences_out", "dropped_count", "state_const_count")
FLAGS = ("has_pii_after", "has_first_person_after", "method_keywords_present")


def distilled(text: Column) -> Column:
    """struct of the clean text, the reasons of dropped sentences and the report; a null text is empty."""
    fields = "text string, reasons array<string>, " + ", ".join([f"{c} int" for c in REPORT] + [f"{c} boolean" for c in FLAGS])

    @F.pandas_udf(fields)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            out, dropped, report = distill(t)
            rows.append({"text": out, "reasons": [r for _, r in dropped], **report})
        return pd.DataFrame(rows, columns=["text", "reasons", *REPORT, *FLAGS])

    return run(F.coalesce(text, F.lit("")))
