"""Local identifiers out of texts and of JSON values: paths, hosts, birth data, and names that a path gives away.

A path names its owner, and the name then stands elsewhere in the same row. So a row's values are read once for names and
rewritten with all of them. A value that is JSON is rewritten string by string in place: keys, numbers, order and white space
stay as they are. The work on a text is sequential by nature (what one rule writes the next one reads) and runs in tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.runtime import bounded_batches, free_names

# Patterns of paths, hosts and birth data, their placeholders, and names that stand for no person.
_SEG = r'[^\s\\/:*?"<>|]+'
WINDOWS = re.compile(r"(?<![A-Za-z])(?<![\\]u[0-9a-fA-F]{3})([A-Za-z]):([\\/])(" + _SEG + r"(?:[\\/]" + _SEG + r")*)")
MSYS = re.compile(r"(?<![\w.:/])/([A-Za-z])((?:/" + _SEG + r")+)")
POSIX_HOME = re.compile(r"(?<![\w.>])/(?:home|Users|users)/([A-Za-z0-9_.-]+)((?:/" + _SEG + r")*)")
UNC = re.compile(r"\\\\([A-Za-z0-9_.-]+)((?:\\[^\s\\]*)+)")
TILDE = re.compile(r"(?<![\w.>~])~((?:/" + _SEG + r")+)")
PRIVATE_IP = re.compile(r"\b(?:(?:192\.168|10)\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3})\b")
OWNER = re.compile(r"(?:(?<![A-Za-z])[A-Za-z]:[\\/]Users[\\/]|(?<![\w.>])/(?:home|Users|users)/)([A-Za-z0-9_.-]+)", re.IGNORECASE)
_PILLAR = "[甲乙丙丁戊己庚辛壬癸][子丑寅卯辰巳午未申酉戌亥]"
PILLARS = re.compile(rf"(?:{_PILLAR})(?:[\s/／、,，]*(?:{_PILLAR})){{3}}")
BIRTH_DATE = re.compile(r"(?i)(生日|出生|生于|诞辰|birthday|born|birth\s*date)(\s*[是为:：]?\s*)(\d{4}[-/]\d{1,2}[-/]\d{1,2})")
HOMES = ("users", "home")
NO_PERSONS = ("users", "user", "home", "public", "default", "all", "administrator", "temp")
SLOTS = ("admin", "administrator", "user", "users", "public", "private", "default", "all", "any", "none", "root", "guest", "operator", "current", "test", "tmp", "temp")
SPLIT_FILE = re.compile(r"\b([a-z][a-z0-9_\-]{1,})\. (html?|py|js|json|md|sh|xml|csv|txt|log|ini|cfg|conf|css|exe|dll|so|whl|jar|bin)\b")
SPLIT_IDENTIFIER = re.compile(r"\b([a-z][a-z0-9_]*)\. (_[a-z][a-z0-9_]*)\b")
SPLIT_FOLDER = re.compile(r"(?<=/)\. (venv|git|config|local|data|cache|ssh|npm)\b")
SPLIT_DOMAIN = re.compile(r"\b([a-z][a-z0-9\-]{1,}(?:\. [a-z][a-z0-9\-]{1,})*)\. (com|net|org|cn|io|dev|app|co|me|ai|info|biz)\b")
STRING = re.compile(r'("(?:[^"\\]|\\.)*")(\s*:)?')
PASSES = 3


class Change(NamedTuple):
    """One rewritten place."""

    kind: str
    sample: str
    replacement: str


CHANGES = "array<struct<kind:string,sample:string,replacement:string>>"


def names_in(text: str) -> set[str]:
    """Owners of the paths in a text, of three characters or more and not the name of a role."""
    return {m[1] for m in OWNER.finditer(text) if len(m[1]) >= 3 and m[1].lower() not in NO_PERSONS}


def persons(names: Iterable[str]) -> set[str]:
    """Of names known beforehand those that can stand for a person."""
    def slot(n: str) -> bool:
        return n in SLOTS or n.startswith("_") or n.endswith(("-test", "_test"))

    return {n for n in names if n and len(n.strip()) >= 3 and not slot(n.strip().lower())}


def _tail(parts: list[str], sep: str) -> str:
    """A path without its first part, or without a home folder and the name in it."""
    home = parts[0].lower() in HOMES
    return sep.join(["<home>" if home else "<root>", *parts[2 if home else 1 :]])


def _rules() -> list[tuple[str, re.Pattern, object]]:
    """(kind, pattern, what a match becomes), in the order in which a pass applies them."""
    split = lambda m, k: [p for p in re.split(r"[\\/]", m[k]) if p]
    return [
        ("windows_path", WINDOWS, lambda m: _tail(split(m, 3), m[2])),
        ("msys_path", MSYS, lambda m: _tail(split(m, 2), "/")),
        ("posix_home", POSIX_HOME, lambda m: "<home>" + m[2]),
        ("unc_host", UNC, lambda m: r"\\<host>" + m[2]),
        ("tilde_home", TILDE, lambda m: "<home>" + m[1]),
        ("private_ip", PRIVATE_IP, lambda m: "<private-host>"),
    ]


def _rewrite(text: str, kind: str, pattern: re.Pattern, becomes, changes: list[Change]) -> str:
    def one(m: re.Match) -> str:
        out = becomes(m)
        if out is None:
            return m[0]
        changes.append(Change(kind, m[0], out))
        return out

    return pattern.sub(one, text)


def without_name(text: str, name: str) -> str:
    """A name becomes <user> where it stands as a word; one that is not ASCII wherever it stands."""
    if name not in text:
        return text
    return re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", "<user>", text) if name.isascii() else text.replace(name, "<user>")


def _without_names(text: str, names: set[str], changes: list[Change]) -> str:
    for name in sorted(names, key=lambda n: (-len(n), n)):
        shorter = without_name(text, name)
        if shorter != text:
            changes.append(Change("username", name, "<user>"))
            text = shorter
    return text


def scrub(text: str, known: set[str] = frozenset()) -> tuple[str, list[Change]]:
    """A text without local identifiers, and what was changed.

    Paths can hide in paths, so the rules run up to three times, until nothing changes; names are learned before that, while
    paths still show them. Four pillars need two different stems to be a birth chart.
    """
    names, changes = names_in(text) | persons(known), []
    for _ in range(PASSES):
        before = text
        for kind, pattern, becomes in _rules():
            text = _rewrite(text, kind, pattern, becomes, changes)
        if text == before:
            break
    text = _rewrite(text, "birth_pillars", PILLARS, lambda m: "<birth-pillars>" if len(set(m[0][::3])) > 1 else None, changes)
    text = _rewrite(text, "birth_date", BIRTH_DATE, lambda m: m[1] + m[2] + "<birth-date>", changes)
    return _without_names(text, names, changes), changes


def rejoin(text: str) -> tuple[str, list[Change]]:
    """File names, identifiers, hidden folders and domains put together again where a sentence splitter cut them."""
    changes: list[Change] = []
    text = _rewrite(text, "split_file", SPLIT_FILE, lambda m: f"{m[1]}.{m[2]}", changes)
    text = _rewrite(text, "split_identifier", SPLIT_IDENTIFIER, lambda m: f"{m[1]}.{m[2]}", changes)
    text = _rewrite(text, "split_dotdir", SPLIT_FOLDER, lambda m: f".{m[1]}", changes)
    return _rewrite(text, "split_domain", SPLIT_DOMAIN, lambda m: f"{m[1]}. {m[2]}".replace(". ", "."), changes), changes


def scrub_value(value: str, names: set[str]) -> tuple[str, list[Change]]:
    """A value as JSON where it is an object or a list, string by string, else as text; broken JSON is text.

    A string that holds JSON itself is treated in the same way. Keys stay.
    """
    try:
        parsed = json.loads(value) if value.lstrip()[:1] in ("{", "[") else None
    except (ValueError, RecursionError):
        parsed = None
    if not isinstance(parsed, (dict, list)):
        text, changes = scrub(value)
        return _without_names(text, names, changes), changes
    changes: list[Change] = []

    def leaf(m: re.Match) -> str:
        if m[2]:  # a key
            return m[0]
        text, own = scrub_value(json.loads(m[1]), names)
        changes.extend(own)
        return json.dumps(text, ensure_ascii=False) if own else m[0]

    return STRING.sub(leaf, value), changes


def scrub_row(values: list[str | None], known: set[str] = frozenset()) -> tuple[list[str | None], list[Change]]:
    """All text values of a row, rewritten with the names that any of them shows; null and empty values stay."""
    names, out, changes = persons(known), [], []
    for v in values:
        names |= names_in(v or "")
    for v in values:
        if v:
            v, own = scrub_value(v, names)
            changes += own
            v, own = rejoin(v)
            changes += own
        out.append(v)
    return out, changes


def scrubbed(text: Column, known: Iterable[str] = ()) -> Column:
    """struct<text, changes> of a text column; null stays null with no changes."""
    names = set(known)

    @F.pandas_udf(f"text string, changes {CHANGES}")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(t, []) if t is None else scrub(t, names) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "changes": [[c._asdict() for c in r[1]] for r in rows]})

    return run(text)


def scrub_values(rows: DataFrame, columns: list[str], known: Iterable[str] = ()) -> DataFrame:
    """rows with the named string columns scrubbed together, and `changes` (kind, sample, replacement) of each row in order.

    Names learned from one column are taken out of all. A column named changes is left out; no rows give no rows.
    """
    bounded_batches(rows.sparkSession)
    names = set(known)
    (temp,) = free_names(rows, "scrubbed_")

    @F.pandas_udf(f"out array<string>, changes {CHANGES}")
    def run(values: pd.Series) -> pd.DataFrame:
        done = [scrub_row(list(v), names) for v in values]
        return pd.DataFrame({"out": [r[0] for r in done], "changes": [[c._asdict() for c in r[1]] for r in done]})

    made = rows.withColumn(temp, run(F.array(*[F.col(f"`{c}`") for c in columns])))
    at = {c: k for k, c in enumerate(columns)}
    kept = [F.col(temp)["out"][at[c]].alias(c) if c in at else F.col(f"`{c}`") for c in rows.columns if c.lower() != "changes"]
    return made.select(*kept, F.col(temp)["changes"].alias("changes"))
