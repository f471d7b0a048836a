"""Signals of private content in a text, in English and Chinese, and who may see it: values, first person, emotion, residence.

The full rules; the ASCII forms that SQL can say are in screening and records. They look around a match and at the words near it,
so a text is read in Python within a task, a batch of texts at a time.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of private values with their severity, in order.
VALUES = [
    ("phone", re.compile(r"(?:\b1[3-9]\d{9}\b|\b\d{3}[-.\s]\d{3,4}[-.\s]\d{4}\b|\+\d{1,3}[-.\s]?\d{4,14})"), "redact"),
    ("email", re.compile(r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"), "redact"),
    ("cn_id_card", re.compile(r"\b\d{17}[\dXx]\b"), "redact"),
    ("ssn", re.compile(r"\b\d{3}-\d{2}-\d{4}\b"), "redact"),
    ("bank_card", re.compile(r"\b\d{16,19}\b"), "redact"),
    ("wechat_chat_id", re.compile(r"\bo[A-Za-z0-9_-]{20,}@im\.wechat\b"), "redact"),
]
LATER_VALUES = [
    ("telegram_chat_id", re.compile(r"(?:telegram|discord|wechat|slack|whatsapp|微信|电报|飞书)\s*(?:chat[_\s-]?id|user[_\s-]?id)?\s*[:=]?\s*\d{6,}", re.I), "redact"),
    ("keyed_identifier", re.compile(r"\b(?:message|msg|chat|session|conversation|bot|account|user|thread|group|channel)[_\s-]?id\s*[:=]\s*(?:[0-9a-f]{8,}|[0-9]{8,})", re.I), "redact"),
    (
        "credential_value",
        re.compile(
            r"(?:api[_-]?key|secret|token|password|passwd|pwd|私钥|密钥|密码|口令)\s*(?:[:=]|是|为|\bis\b)\s*['\"]?[A-Za-z0-9_\-\.]{8,}|\bgh[pousr]_[A-Za-z0-9]{16,}|\bsk-[A-Za-z0-9]{16,}"
            r"|\bAKIA[0-9A-Z]{12,}|\bxox[baprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAIza[0-9A-Za-z_\-]{30,}"
        ),
        "redact",
    ),
]
DIGIT = re.compile(r"\d")
CHAT_NUMBER = re.compile(r"\b\d{8,12}\b")
TOPIC = re.compile(r"身份证|银行卡|社保|住址|户口|手机号|微信号|邮箱|账号|(?<![A-Za-z])QQ(?![A-Za-z])|SSN|social security|address|phone number|credit card|bank account|passport|driver.{0,3}license")
# Pronouns, what makes a plural one personal, and words after which I is a number.
SINGULAR = re.compile(r"我(?!们|自己)|我的|我自己|家里|\bmy\b|\bmine\b|\bme\b|\bhome address\b")
PLURAL = re.compile(r"我们|\bour\b|\bus\b|\bwe\b")
LETTER_I = re.compile(r"\bI\b")
WORD_BEFORE = re.compile(r"([A-Za-z-]+)\s*$")
NUMBERED = set("class part step section phase stage level type item note lesson r r-class version no rule gate appendix chapter ship".split())
PERSONAL = [
    re.compile(
        r"家人|family|账户|余额|存款|工资|收入|资产|信用卡|贷款|投资组合|持仓|老婆|老公|女朋友|男朋友|父母|父亲|母亲|爸爸|妈妈|孩子|女儿|儿子|住址|地址|手机号|微信号|邮箱|身份证|银行卡|社保|户口|"
        r"用户主张|用户希望|用户偏好|用户要求|用户规定|用户不满|用户批评|用户明确|用户强调|用户声明|用户拒绝|用户纠正|用户说|本人|\baddress\b|\bpassword\b|\baccount\b|\bsalary\b|\bincome\b|\bwife\b|\bhusband\b|\bdaughter\b|\bson\b"
    ),
    re.compile(
        r"密钥|私钥|口令|凭据|凭证|营收|估值|净值|仓位|持股|客户名单|客户群|供应商|报价|未发布|尽调|股东|股份|行程|旅行计划|确诊|处方|病历|管理员|权限|分工|租金|房贷|\bsecret\b|\btoken\b|\bapi key\b|\bprivate key\b|\bcredential\b|"
        r"\brevenue\b|\bvaluation\b|\bnet value\b|\bportfolio\b|\bholdings?\b|\bpositions?\b|\bclient list\b|\bsupplier\b|\bquote[sd]?\b|\bunreleased\b|\bproprietary\b|\bconfidential\b|\bdo not share\b|"
        r"\bdiagnosis\b|\bprescription\b|\brent\b|\bmortgage\b|\badministrator\b|\bpermissions?\b"
    ),
    re.compile(r"(?:我们|咱|we)\s*(?:搬|住|租|定居|落脚|移居|安家)|\bwe\s+(?:moved|relocated|live|rent|stay)|房东|landlord|房租|租金"),
    re.compile(r"猫|狗|宠物|宝宝|婴儿|\bkids?\b|\bchild(?:ren)?\b|\bbaby\b|\bpets?\b|\bcat\b|\bdog\b|\bnewborn\b"),
    re.compile(r"手术|住院|化验|处方|复查|病假|\bsurgery\b|\bhospitali[sz]ed\b|\bprescription\b|\bchemotherapy\b|\bclinic\b|\bstroke\b"),
    re.compile(r"旅行|旅游|行程|机票|酒店|度假|出发地|签证|\btravel\b|\btrip\b|\bvacation\b|\bflight\b|\bitinerary\b|\btickets?\b"),
    re.compile(r"(?:打算|计划|准备|考虑)\s*[^\n]{0,6}(?:卖掉|出售|并购|收购|融资|上市|裁员|关停|合并|退市)|\b(?:plan|intend|going)\s+to\s+(?:sell|merge|acquire|raise|buy|IPO|lay\s+off|shut\s+down)\b"),
]
EMOTION = re.compile(r"想自杀|自杀|抑郁|抑郁症|诊断|\bsuicidal\b|\bsuicide\b|\bdepression\b|\bdepressed\b|\banxiety\b")
RESIDENCE = re.compile(r"(?:我|我的|\bmy\b|\bI\b).{0,5}(?:在|住|住址|住在|address|live in).{0,40}(?:北京|上海|深圳|广州|杭州|成都|武汉|东京|大阪|Beijing|Shanghai|Tokyo|New York|Calgary|Toronto)")
# Kinds that may be shared, and what a text about knowledge says.
SHARED_KINDS = ("method", "recipe", "lesson", "success_pattern", "failure_pattern", "mental_model", "knowledge_page", "flow")
KNOWLEDGE = re.compile(
    r"\b(method|recipe|lesson|pattern|workflow|step[- ]by[- ]step|how[- ]to)\b|(方法|流程|步骤|教程|配方|实战|技巧|模板|方案|操作指南|经验总结|踩坑|总结|最佳实践)|"
    r"curl\s*[+−-]?\s*(?:chrome\s*)?UA|(?:article\s*)?fetch\s*(?:method|workflow)|(?:how\s*to|怎么|如何)\s*(?:抓取|获取|访问|爬|爬取|读取)"
)
NEAR = 24


def luhn(digits: str) -> bool:
    """Does a number of 13 digits or more end with its check digit?"""
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return len(digits) >= 13 and (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def private_values(text: str) -> list[tuple[str, str, str]]:
    """(name, severity, sample) of private values, by rule and then by place; a topic alone is to be reviewed."""
    # most texts lack what a rule needs: a digit, or one of its signs
    digit = DIGIT.search(text) is not None
    can = {"email": "@" in text, "wechat_chat_id": "@im.wechat" in text, "keyed_identifier": "=" in text or ":" in text, "credential_value": True}
    out = [(name, severity, m[0]) for name, pattern, severity in VALUES if can.get(name, digit) for m in pattern.finditer(text) if name != "bank_card" or luhn(m[0])]
    if TOPIC.search(text):
        out.append(("pii_keyword_context", "review", "context-only"))
        for m in CHAT_NUMBER.finditer(text):
            if TOPIC.search(text[max(0, m.start() - NEAR) : m.end() + NEAR]):
                out.append(("telegram_chat_id", "redact", m[0]))
    for name, pattern, severity in LATER_VALUES:
        if can.get(name, digit):
            out += [(name, severity, m[0][:NEAR] if name == "credential_value" else m[0]) for m in pattern.finditer(text)]
    return out


def _pronoun_i(text: str) -> bool:
    for m in LETTER_I.finditer(text):
        before = WORD_BEFORE.search(text, max(0, m.start() - 64), m.start())
        if not before or before[1].lower() not in NUMBERED:
            return True
    return False


def first_person(text: str) -> bool:
    """A singular pronoun, or a plural one in a text with something personal."""
    return bool(SINGULAR.search(text)) or _pronoun_i(text) or bool(PLURAL.search(text) and any(p.search(text) for p in PERSONAL))


def signals(text: str) -> list[str]:
    """Names of the signals that a text shows: pii, first_person, emotion, geographic."""
    found = (("pii", private_values(text)), ("first_person", first_person(text)), ("emotion", EMOTION.search(text)), ("geographic", RESIDENCE.search(text)))
    return [name for name, hit in found if hit]


def visibility(text: str, kind: str | None, hint: str | None, confidence: float | None, allowed: bool = True) -> tuple[str, str, list[str], bool]:
    """(commons or personal, reason, signals, may be overridden)."""
    shown, shared = signals(text), kind in SHARED_KINDS
    if not allowed:
        return "personal", "admin_disabled_commons_write", shown, True
    if hint == "commons":
        if shown:
            return "personal", "hint_commons_blocked_by_signals", shown, False
        return ("personal", "kind_not_shareable", shown, False) if kind and not shared else ("commons", "user_hint_commons", shown, True)
    if hint == "personal":
        return "personal", "user_hint_personal", shown, True
    known = kind if shared else "content_inferred" if KNOWLEDGE.search(text) else None
    if known and (confidence or 0.0) >= 0.7 and not shown:
        return "commons", f"kind_{known}_auto_promote", shown, True
    return "personal", "default_personal", shown, True


def values_of(text: Column) -> Column:
    """array<struct<name, severity, sample>> of private values; null has none."""

    @F.pandas_udf("array<struct<name:string,severity:string,sample:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("name", "severity", "sample"), v)) for v in private_values(t)] for t in texts], dtype=object)

    return run(F.coalesce(text, F.lit("")))


def signals_of(text: Column) -> Column:
    """array<string> of the signals of a text; null has none."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(signals)

    return run(F.coalesce(text, F.lit("")))


def visibility_of(text: Column, kind: Column, hint: Column, confidence: Column, allowed: bool = True) -> Column:
    """struct<visibility, reason, signals, override> of each row; null texts are empty."""

    @F.pandas_udf("visibility string, reason string, signals array<string>, override boolean")
    def run(texts: pd.Series, kinds: pd.Series, hints: pd.Series, sure: pd.Series) -> pd.DataFrame:
        rows = [visibility(t, k, h, None if pd.isna(c) else c, allowed) for t, k, h, c in zip(texts, kinds, hints, sure)]
        return pd.DataFrame(rows, columns=["visibility", "reason", "signals", "override"])

    return run(F.coalesce(text, F.lit("")), kind.cast("string"), hint.cast("string"), confidence.cast("double"))
