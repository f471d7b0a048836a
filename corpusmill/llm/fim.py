"""Fill-in-middle transformation with a piece table.

A document is a list of descriptors (buffer, start, size) over two buffers that never change: its text and the sentinels. A
cut splits the descriptor it falls in, an arrangement permutes descriptors and puts each part's sentinel before it, the
inverse permutation restores the order, and hashes read the buffers through the descriptors. No text is copied until a caller
asks for the transformed one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.plans.runtime import bounded_batches, free_names

SEED = "1"
#: Per cent of texts that are transformed, and of these the per cent with the suffix first.
FIM_SHARE, SPM_SHARE = 90, 20
TEXT, SENTINEL = 0, 1
PREFIX, MIDDLE, SUFFIX = 0, 1, 2
MARKS = {PREFIX: b"<P>", MIDDLE: b"<M>", SUFFIX: b"<S>"}
SENTINELS = b"".join(MARKS.values())
#: Parts of the document in the order of the output.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


class Piece(NamedTuple):
    """size bytes of a buffer from start on."""

    buffer: int
    start: int
    size: int


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and after byte `at` of the document that they spell; a piece across it is split."""
    before, after, seen = [], [], 0
    for p in pieces:
        left = min(max(at - seen, 0), p.size)
        if left:
            before.append(p._replace(size=left))
        if left < p.size:
            after.append(p._replace(start=p.start + left, size=p.size - left))
        seen += p.size
    return before, after


def arrange(parts: list[list[Piece]], order: tuple[int, ...]) -> list[Piece]:
    """The parts in the given order, each after the descriptor of its sentinel."""
    out = []
    for part in order:
        out.append(Piece(SENTINEL, SENTINELS.index(MARKS[part]), len(MARKS[part])))
        out += parts[part]
    return out


def disarrange(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output that spell the text it was made of.

    The text holds no sentinel and none can arise at a seam (a sentinel has its first and last character nowhere else), so the
    first one after the part before it is the real one.
    """
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    order, starts, at = ORDERS[form], [], 0
    for part in order:
        at = output.index(MARKS[part], at) + len(MARKS[part])
        starts.append(at)
    ends = [starts[k] - len(MARKS[part]) for k, part in enumerate(order)][1:] + [len(output)]
    inverse = np.argsort(order)
    return [Piece(TEXT, starts[k], ends[k] - starts[k]) for k in inverse]


def slices(pieces: Iterable[Piece], text: bytes) -> Iterator[memoryview]:
    """What the pieces spell, as views of the buffers."""
    buffers = memoryview(text), memoryview(SENTINELS)
    for p in pieces:
        yield buffers[p.buffer][p.start : p.start + p.size]


def digest(pieces: Iterable[Piece], text: bytes) -> str:
    """Lowercase hex SHA-256 of what the pieces spell, read through the descriptors."""
    h = hashlib.sha256()
    for s in slices(pieces, text):
        h.update(s)
    return h.hexdigest()


class Plan(NamedTuple):
    """A document's form, its code points, those of prefix and middle, and the descriptors of the output."""

    n: int
    form: str
    prefix: int | None
    middle: int | None
    pieces: list[Piece]


def plan(ident: str, text: bytes, seed: str = SEED, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE) -> Plan:
    """How the document is cut and arranged: two cuts and the form come from the hash of seed and id alone."""
    h1, h2, h3, h4 = np.frombuffer(hashlib.sha256(f"{seed}:{ident}".encode()).digest()[:16], dtype=">u4").tolist()
    heads = np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80  # first bytes of code points
    n = int(np.count_nonzero(heads))
    whole = [Piece(TEXT, 0, len(text))]
    if not n or h3 % 100 >= fim_share or any(m in text for m in MARKS.values()):
        return Plan(n, "plain", None, None, whole)
    form = "spm" if h4 % 100 < spm_share else "psm"
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    starts = np.append(np.flatnonzero(heads), len(text))
    starts[0] = 0
    rest, suffix = cut(whole, int(starts[second]))
    prefix, middle = cut(rest, int(starts[first]))
    return Plan(n, form, first, second - first, arrange([prefix, middle, suffix], ORDERS[form]))


_COLUMNS = "n long, form string, prefix_chars long, middle_chars long"
TRANSFORMED = ("n", "form", "prefix_chars", "middle_chars", "fim_text")
DIGESTED = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _planned(seed: str, fim_share: int, spm_share: int, digests: bool):
    """A pandas UDF from id and text: the plan, and either the output or the digests of output and restored text."""
    last = "output_sha256 string, restored_sha256 string" if digests else "fim_text binary"

    @F.pandas_udf(f"{_COLUMNS}, {last}")
    def run(idents: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for ident, text in zip(idents, texts):
            p = plan(ident, text, seed, fim_share, spm_share)
            if digests:
                output = b"".join(slices(p.pieces, text))
                end = digest(p.pieces, text), digest(disarrange(output, p.form), output)
            else:
                end = (b"".join(slices(p.pieces, text)),)
            rows.append((p.n, p.form, p.prefix, p.middle, *end))
        made = pd.DataFrame(rows, columns=list(DIGESTED if digests else TRANSFORMED))
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run


def _added(docs: DataFrame, made: Column, names: tuple[str, ...]) -> DataFrame:
    (temp,) = free_names(docs, "fim_")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    one = {c: F.col(temp).getField(c) for c in names}
    if "fim_text" in one:
        one["fim_text"] = one["fim_text"].cast("string")
    return docs.withColumn(temp, made).select(*kept, *[x.alias(c) for c, x in one.items()])


def _inputs() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")).cast("binary")


def transform(docs: DataFrame, seed: str = SEED, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and fim_text to docs (doc_id, text, ...).

    A null text counts as empty, a null id as ''; rows with one id draw the same numbers, repeated rows stay. Empty texts and
    texts with a sentinel are plain; long texts are cut anywhere; columns of docs with the added names are left out; no rows
    give no rows. One pass without a shuffle.
    """
    bounded_batches(docs.sparkSession)
    return _added(docs, _planned(seed, fim_share, spm_share, False)(*_inputs()), TRANSFORMED)


def restore(rows: DataFrame, output: str = "fim_text", form: str = "form") -> DataFrame:
    """Add restored: the text that an output of the given form was made of. A null output or form gives null."""
    bounded_batches(rows.sparkSession)

    @F.pandas_udf("binary")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else b"".join(slices(disarrange(o, f), o)) for o, f in zip(outputs, forms)], dtype=object)

    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != "restored"]
    return rows.select(*kept, run(F.col(output).cast("binary"), F.col(form)).cast("string").alias("restored"))


def digests(docs: DataFrame, seed: str = SEED, fim_share: int = FIM_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 to docs; rows are treated as in transform.

    The restored text is read from output and form alone. Neither text leaves the task.
    """
    bounded_batches(docs.sparkSession)
    return _added(docs, _planned(seed, fim_share, spm_share, True)(*_inputs()), DIGESTED)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, length(text) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
