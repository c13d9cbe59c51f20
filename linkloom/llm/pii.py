"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds, leftmost and without overlap within a kind: email, ip (parts of at most 255), card (14 to 19
digits that pass Luhn) and phone (a plus sign, 10 to 15 digits); these count whatever stands nearby. The method
adds iban (its country's length and mod 97), local phone numbers, national numbers and secrets; each has a prior score,
which a word of its context, a whole one within ``NEAR`` characters on either side, raises and a word of another context
lowers, and counts from ``LEAST`` on. Added spans never overlap a base span.

Matching is linear in the text's length. Defined cases: a null or empty text has no spans; repeated documents
each get their row; other columns are ignored by the report and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._common import edit_rows, map_batches

KINDS = ("email", "ip", "card", "phone")
MORE = ("iban", "local_phone", "national_id", "secret")
NEAR, LEAST = 40, 0.6

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile(r"[0-9]")

# fixed values: characters of an IBAN by country (ISO 13616)
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=[ ]?[A-Z0-9])")
_IBAN_REST = {n: re.compile(rf"(?:[ ]?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(_IBAN_LENGTH.values())}


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        length = _IBAN_LENGTH.get(m[1])
        if length and (rest := _IBAN_REST[length].match(text, m.end())) and mod97(text[m.start() : rest.end()]):
            yield m.start(), rest.end()


def _matches(pattern: str):
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def _words(*words: str) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{'|'.join(words)})(?!\w)")


_EXAMPLE = ("example", "examples")
_NUMBERS = (*_EXAMPLE, "order", "isbn", "version", "serial")  # what other long numbers are called
#: what proposes spans, prior score, words that raise it, words that lower it
_PROPOSED = {
    "iban": (_ibans, 0.7, _words("iban", "account", "konto", "cuenta", "compte"), _words(*_EXAMPLE)),
    "local_phone": (
        _matches(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
        0.5, _words("phone", "tel", "telephone", "call", "mobile", "fax", "telefon"), _words(*_NUMBERS),
    ),
    "national_id": (
        _matches(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"),
        0.5, _words("ssn", "social security", "passport", "national id"), _words(*_NUMBERS),
    ),
    "secret": (
        _matches(
            r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?i:password|passwd|secret|token|api_key|apikey)"
            r"[ ]{0,2}[=:][ ]{0,2}[\"']?[A-Za-z0-9+/_.-]{12,})(?![A-Za-z0-9])"
        ),
        0.7, _words("key", "secret", "token", "password", "credential"), _words(*_EXAMPLE),
    ),
}
_SECRET_WORDS = ("akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "password", "passwd", "secret", "token", "api_key", "apikey")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        if at >= last and (m := _DOMAIN.match(text, at)):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", at + 1)


def _context(text: str, a: int, b: int) -> str:
    """What stands within NEAR characters of a span, in lower case, without words that are cut there."""
    first, last = max(0, a - NEAR), b + NEAR
    while 0 < first < a and (text[first - 1].isalnum() or text[first - 1] == "_") and (text[first].isalnum() or text[first] == "_"):
        first += 1
    while b < last < len(text) and (text[last].isalnum() or text[last] == "_") and (text[last - 1].isalnum() or text[last - 1] == "_"):
        last -= 1
    return f"{text[first:a]}\n{text[b:last]}".lower()


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """start, end, kind in code points, sorted by start and then by kind as listed."""
    if not text:
        return []
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    digits = _DIGIT.search(text) is not None  # most texts have none, and no kind but email does without
    for m in _IP.finditer(text) if digits and "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in _CARD.finditer(text) if digits else ():
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((*m.span(), 2))
    if digits and "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((*m.span(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def more_spans(text: str | None, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What the method adds, apart from spans that are taken."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    busy: list[tuple[int, int]] = []  # what is taken, as intervals in order that do not overlap
    for a, b in sorted((a, b) for a, b, _ in taken):
        if busy and a < busy[-1][1]:
            busy[-1] = (busy[-1][0], max(b, busy[-1][1]))
        else:
            busy.append((a, b))
    digits, lower = _DIGIT.search(text) is not None, text.lower()
    for kind, (propose, prior, raises, lowers) in _PROPOSED.items():
        if not (any(w in lower for w in _SECRET_WORDS) if kind == "secret" else digits):
            continue
        for a, b in propose(text):
            near = _context(text, a, b)
            score = prior + 0.3 * bool(raises.search(near)) - 0.2 * bool(lowers.search(near))
            k = bisect_left(busy, (b, 0))
            if score >= LEAST and not (k and busy[k - 1][1] > a):
                found.append((a, b, kind))
                busy.insert(k, (a, b))
    return found


def spans(text: str | None) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    order = {k: i for i, k in enumerate(KINDS + MORE)}
    return sorted(base + more_spans(text, base), key=lambda s: (s[0], order[s[2]]))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of their spans, and all spans."""

    def report(cols):
        base = [base_spans(t) for t in cols["text"]]
        out = {f"n_{k}": [sum(s[2] == k for s in b) for b in base] for k in KINDS}
        yield out | {
            "doc_id": cols["doc_id"],
            "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
            "spans": [_joined(spans(t)) for t in cols["text"]],
        }

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, report, RESULT)


def masked(text: str | None) -> str | None:
    """text with each span, overlapping ones as one, replaced by its first kind in angle brackets."""
    if not text or not (found := spans(text)):
        return text
    out, at, k = [], 0, 0
    while k < len(found):
        a, b, kind = found[k]
        while k < len(found) and found[k][0] < b:
            b = max(b, found[k][1])
            k += 1
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, personal data masked; n_chars, if there is one, follows the text."""
    counted = "n_chars" in docs.columns

    def edit(texts):
        new = [masked(t) for t in texts]
        return None, {"text": new} | ({"n_chars": [None if t is None else len(t) for t in new]} if counted else {})

    return edit_rows(docs, "text", edit)
