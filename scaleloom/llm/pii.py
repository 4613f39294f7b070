"""Personal data and secrets: regular expressions propose spans, checksums confirm them, context words adjust the score.

The first four kinds are reported whatever their score; of the others those that reach LEAST_SCORE.

Offsets are code points, ends exclusive. Edge cases: a null text counts as empty and has no span;
null ids and repeated rows each get their row; an empty table gives no rows; other columns are kept
by ``mask_pii`` and ignored by ``find_pii``. Every text is scanned whole, in time linear in its length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed; the first four are always reported.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone", "secret")
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"
#: Least score of the kinds beyond the base ones, and code points before and after a span that count as its context.
LEAST_SCORE, BEFORE, AFTER = 0.6, 48, 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A failed or finished match never leaves its run of digits, so a start inside a run needs no try.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
_DIGIT = re.compile(r"[0-9]")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
#: Keys that show what they are by their form, and blocks of private keys.
_KNOWN_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsru]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}"
    r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)(?![A-Za-z0-9])"
)
_KEY_HEAD, _KEY_FOOT = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
_ASSIGNED = re.compile(
    r"""(?i)(?<![A-Za-z0-9])(?:(passw(?:or)?d|passphrase|pwd|passwort|contraseña)|api[_ -]?key|access[_ -]?key|private[_ -]?key|secret(?:[_ -]?(?:key|token))?|(?:auth|access|refresh)?[_ -]?token)["']?[ \t]{0,3}(?:=>|:=|[:=])[ \t]{0,3}["']?([^\s"'<>,;]{6,})"""
)
#: By kind the score before context, and the words that raise it.
_BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.85, "ssn": 0.45, "local_phone": 0.4, "secret": 0.6}
_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|client|login|adresse|dirección)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|payment|karte|kreditkarte|carte|tarjeta)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|bic|swift|bank|account|konto|kontonummer|compte|cuenta|banco|banque)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|tax ?id|taxpayer)\b"),
    "phone": (phone := re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|anruf|handy|téléphone|appelez|teléfono|móvil|llame)\b")),
    "local_phone": phone,
    "secret": re.compile(r"(?i)\b(?:secret|token|key|password|passwd|credentials?|auth|login|private)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:order|invoice|version|part|model|serial|isbn|sku|page|example|placeholder)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one @, and its start does not matter to what follows: look left from each @."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _score(kind: str, text: str, start: int, end: int, base: float | None = None) -> float:
    """The score of the kind (or ``base``), raised and lowered by the words around the span; between 0 and 1."""
    near = text[max(0, start - BEFORE) : start] + " " + text[end : end + AFTER]
    score = _BASE_SCORE[kind] if base is None else base
    if _CONTEXT[kind].search(near):
        score += 0.35 if kind not in BASE_KINDS else 0.1
    if _AGAINST.search(near):
        score -= 0.25
    return round(min(1.0, max(0.0, score)), 3)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """As many characters as the country's IBAN has, single spaces in between, with the checksum right."""
    for m in _IBAN_HEAD.finditer(text):
        n = IBAN_LENGTHS.get(m[1])
        rest = _IBAN_REST[n].match(text, m.end()) if n else None
        if rest and mod97(text[m.start() : rest.end()]):
            yield m.start(), rest.end()


def _secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score before context) of keys, tokens and passwords; of an assignment its value."""
    for m in _KNOWN_KEY.finditer(text):
        yield m.start(), m.end(), 0.9
    at, foot = 0, _KEY_FOOT.search(text) if "PRIVATE KEY-----" in text else None
    while (m := _KEY_HEAD.search(text, at)) and foot:
        if foot.start() < m.end():
            foot = _KEY_FOOT.search(text, m.end())
        at = foot.end() if foot else m.end()
        yield m.start(), at, 0.95
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            v = m[2]
            mixed = sum((any(c.isdigit() for c in v), any(c.isalpha() for c in v), any(not c.isalnum() for c in v)))
            yield m.start(2), m.end(2), 0.1 + 0.1 * min(len(v), 20) / 20 + (0.5 if mixed > 1 else 0) - (0.3 if not m[1] and len(v) < 12 else 0)


def _digits(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the kinds that hold digits and no @, the confirmed ones."""
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 14 <= len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()


def spans_of(text: str | None) -> list[tuple[int, int, str, int, float]]:
    """(start, rank of the kind, kind, end, score), sorted. Spans beyond the base kinds do not overlap others."""
    if not text:
        return []
    base = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    more: list[tuple[str, int, int, float | None]] = []
    if _DIGIT.search(text) is not None:
        base += _digits(text)
        more += [("iban", s, e, None) for s, e in _ibans(text)]
        more += [(k, m.start(), m.end(), None) for k, p in (("ssn", _SSN), ("local_phone", _LOCAL_PHONE)) for m in p.finditer(text)]
    more += [("secret", *x) for x in _secrets(text)]
    out = [(s, KINDS.index(k), k, e, _score(k, text, s, e)) for k, s, e in base]
    if more:
        taken = sorted((s, e) for _, s, e in base)
        for kind, s, e, start_score in more:
            i = bisect_left(taken, (s, e))
            free = (i == len(taken) or taken[i][0] >= e) and (i == 0 or max(b for _, b in taken[max(0, i - 4) : i]) <= s)
            if free and (score := _score(kind, text, s, e, start_score)) >= LEAST_SCORE:
                out.append((s, KINDS.index(kind), kind, e, score))
                insort(taken, (s, e))
    return sorted(out)


_STRUCT = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64()), ("score", pa.float64())])


def _find(batches):
    for b in batches:
        found = [[dict(zip(("start", "rank", "kind", "end", "score"), x, strict=True)) for x in spans_of(t)] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_STRUCT))], ["doc_id", "spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (start, rank, kind, end, score), for every row of ``docs`` (doc_id, text); a narrow pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {kind}, spans {SPANS}")


def masked(text: str | None) -> str | None:
    """The text with ``<KIND>`` for each span; of spans that overlap the earlier one."""
    found = spans_of(text)
    if not found:
        return text
    parts, at = [], 0
    for s, _, kind, e, _ in found:
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
        else:
            e = max(e, at)
        at = e
    return "".join([*parts, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` masked and ``n_chars``, if there, brought up to date."""
    at = docs.columns.index("text")

    def mask(batches):
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of the contract from the output of ``find_pii``; n_iban to n_secret, n_spans and the scores (joined like the spans) beside them."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) AS bigint) AS n_{k}") for k in KINDS]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *n[: len(BASE_KINDS)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *n[len(BASE_KINDS) :], F.size("spans").cast("long").alias("n_spans"), scores)
