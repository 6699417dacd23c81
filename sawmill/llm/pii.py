"""Personal data: patterns propose spans, checks confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are the leftmost matches of their patterns that pass their checks; no match is tried
again in another way. The method adds IBANs that pass the mod-97 check; where a match fails it, its shorter ends before a space are tried, the longest
first. A span's score starts at its
kind's and moves with cue words (whole words) within ``NEAR`` characters; scores order spans for a reader, and drop none of them.

Defined cases: null text is empty; empty text has no spans (base_sha256 is that of the empty string, spans is empty); numbers of any length are read, in time in proportion to the text; a null doc_id is
carried through; repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sawmill.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
NEAR = 40

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does, as an earlier start fails only where a later one in the run does; so no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DIGIT = re.compile(r"[0-9]")
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95}
_CUES = {
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "payment", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "bank", "account", "transfer"),
}
_AGAINST = ("example", "sample", "test", "version", "order", "invoice", "serial")
_ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CUE = {k: re.compile(rf"\b(?:{'|'.join(v)})s?\b", re.ASCII) for k, v in _CUES.items()}
_COUNTER = re.compile(rf"\b(?:{'|'.join(_AGAINST)})s?\b", re.ASCII)
_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLE[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _octet(digits: str) -> bool:
    """Whether a number, however long, is at most 255."""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the pattern. A local part is read back from its @, so that text without one costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        m = _EMAIL.match(text, begin) if begin < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """Matches cut at the last space where they pass the check; the search goes on behind what was found, or behind the first group of a match without one."""
    out, m = [], _IBAN.search(text)
    while m:
        a, b = m.span()
        while b > a and not (15 <= len(i := text[a:b].replace(" ", "")) <= 34 and mod97(i)):
            b = text.rfind(" ", a, b)
        if b > a:
            out.append((a, b))
        m = _IBAN.search(text, b if b > a else a + 4)
    return out


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all spans, by start and then kind; starts and ends count code points."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        found += [(a, b, "iban") for a, b in _ibans(text)]
    out = []
    for a, b, kind in sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1])):
        near = f"{text[max(0, a - NEAR) : a]} {text[b : b + NEAR]}".translate(_ASCII_LOWER)
        score = _SCORE[kind] + 0.1 * bool(_CUE[kind].search(near)) - 0.3 * bool(_COUNTER.search(near))
        out.append((a, b, kind, round(min(1.0, max(0.0, score)), 2)))
    return out


def personal_data(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for each row of documents(doc_id, text, ...)."""

    def scan(batches):
        for batch in batches:
            counts, sums, shown, scores = [[] for _ in BASE], [], [], []
            for value in batch.column(1).to_pylist():
                got = spans(value or "")
                for k, kind in enumerate(BASE):
                    counts[k].append(sum(s[2] == kind for s in got))
                text = [f"{kind}:{a}:{b}" for a, b, kind, _ in got]
                sums.append(hashlib.sha256(",".join(t for t, s in zip(text, got) if s[2] in BASE).encode()).hexdigest())
                shown.append(",".join(text))
                scores.append([s[3] for s in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(shown, pa.string()), pa.array(scores, pa.list_(pa.float64()))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def redacted(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """documents with spans of at least this score replaced by their kind in angle brackets; other columns as they came."""

    def redact(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = []
            for value in batch.column(k):
                text = value.as_py()
                done, parts = 0, []
                for a, b, kind, score in spans(text or ""):
                    if score >= least and b > done:
                        if a >= done:
                            parts += [text[done:a], f"<{kind.upper()}>"]
                        done = b
                texts.append(text if text is None or not parts else "".join(parts) + text[done:])
            columns = list(batch.columns)
            columns[k] = pa.array(texts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(redact, documents.schema)
