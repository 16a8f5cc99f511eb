"""Personal data by anchors: an automaton finds cues, local parsers expand and validate what stands around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import packs

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")  # fixed order of kinds
SECRET_CUES = ("token", "api_key", "apikey", "api-key", "secret", "password", "passwd", "key")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn")
# fixed formats: what begins like this is a secret by its shape, without a cue
SECRET_SHAPES = {
    "AKIA": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "AIza": r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z])",
    "ghp_": r"ghp_[0-9A-Za-z]{36,}",
    "sk-": r"sk-[0-9A-Za-z-]{20,}",
    "xox": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "eyJ": r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    "-----BEGIN ": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]{1,8000}-----END [A-Z ]{0,40}PRIVATE KEY-----",
}
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "git", "file")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # groups begin whole and give nothing back: linear in long digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_URL_REST = re.compile(r"[^\s<>\"'|]+")
_SECRET = re.compile(r"[\"']?[ \t]*[=:][ \t]*[\"']?([A-Za-z0-9_/+.=-]{8,})")
_IBAN = re.compile(r"[ \t]*(?:no\.?|number)?[ \t:=#\"']*([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})")
_ACCOUNT = re.compile(r"[ \t]*(?:no\.?|number|nr\.?)?[ \t:=#\"']*([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SSN = re.compile(r"[ \t:=#\"']*([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9])")


_SHAPES = {begin: re.compile(shape) for begin, shape in SECRET_SHAPES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "").upper()
    if not 15 <= len(v) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def automaton():
    """All anchors: at-signs, plus signs, digits, schemes, and cue words in three spellings."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("url", 3))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(cue)))
    for begin in SECRET_SHAPES:
        a.add_word(begin, (begin, len(begin)))
    a.make_automaton()
    return a


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; positions are code points, ends exclusive."""
    found = []
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may begin
    dotted = 0

    def add(kind: str, start: int, end: int) -> None:
        if start >= free[kind]:
            found.append((start, KINDS.index(kind), end))
            free[kind] = end

    for last, (what, width) in anchors.iter(text):
        at = last - width + 1
        if what == "digit":
            if at >= dotted:
                run = _DOTTED.match(text, at)
                dotted = run.end()
                for m in _IP.finditer(text, at, dotted):
                    if _octets(m.group()):
                        add("ip", m.start(), m.end())
            if at >= free["card"]:
                m = _CARD.match(text, at)
                free["card"] = m.end()
                number = _digits(m.group())
                if 12 <= len(number) <= 19 and luhn(number):
                    found.append((at, KINDS.index("card"), m.end()))
        elif what in _SHAPES:
            m = _SHAPES[what].match(text, at)
            if m and not (at and text[at - 1].isalnum()):
                add("secret", at, m.end())
        elif what == "email":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = _LABELS.match(text, at + 1)
            if start < at and m:
                add("email", start, m.end())
        elif what == "phone":
            m = _PHONE.match(text, at)
            if m and 9 <= len(_digits(m.group())) <= 15:
                add("phone", at, m.end())
        elif what == "url":
            scheme = _SCHEME.search(text, max(free["url"], at - 8), at)
            rest = _URL_REST.match(text, last + 1)
            while scheme and scheme.group().lower() not in SCHEMES and scheme.end() - scheme.start() > 1:
                scheme = _SCHEME.search(text, scheme.start() + 1, at)
            if scheme and rest and scheme.group().lower() in SCHEMES:
                tail = rest.group().rstrip(".,;:!?)]}")
                if tail and tail[0] not in "/.:":
                    add("url", scheme.start(), last + 1 + len(tail))
        elif what == "secret":
            m = _SECRET.match(text, last + 1)
            if m and any(c.isdigit() for c in m.group(1)):
                add("secret", m.start(1), m.end(1))
        else:
            if at and text[at - 1].isalnum():
                continue
            cue = text[at : last + 1].lower()
            if cue == "iban":
                m = _IBAN.match(text, last + 1)
                if m:
                    value = m.group(1)
                    while len(value) > 14 and not iban_ok(value):
                        value = value[:-1].rstrip(" ")
                    if iban_ok(value):
                        add("account", m.start(1), m.start(1) + len(value))
            elif cue == "ssn":
                m = _SSN.match(text, last + 1)
                if m and m.group(1) not in ("000", "666") and m.group(1)[0] != "9" and m.group(2) != "00" and m.group(3) != "0000":
                    add("account", m.start(1), m.end())
            else:
                m = _ACCOUNT.match(text, last + 1)
                if m:
                    add("account", m.start(1), m.end(1))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row of ``docs`` (doc_id, text).

    Base kinds are the leftmost non-overlapping matches of their patterns: a match lies inside one run of the
    characters its pattern knows, so parsing each run from its anchor finds the same spans as a scan of the text.
    URLs, account numbers (IBAN check digits, social security ranges, cue words) and secrets come on top.
    NULL or empty text has no spans; rows with equal ids are kept apart; other columns are not read.
    """
    schema = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"

    def scan(batches) -> Iterator:
        import pyarrow as pa

        anchors = automaton()
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for b in packs(batches):
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, anchors)] if t else []
                for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scan, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with every span replaced by its kind in angle brackets; overlaps take the first span."""

    def scan(batches) -> Iterator:
        import pyarrow as pa

        anchors = automaton()
        for b in packs(batches):
            out = []
            for t in b.column("text").to_pylist():
                at, parts = 0, []
                for k, s, e in find_spans(t, anchors) if t else []:
                    if s >= at:
                        parts += [t[at:s], f"<{k}>"]
                        at = e
                out.append(t if t is None else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scan, "doc_id bigint, text string")
