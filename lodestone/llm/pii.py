"""Personal data and secrets: patterns propose spans, validators confirm them, nearby words adjust their scores.

Base kinds (email, ip, card, phone) always stay once their own validator accepts them. The other kinds are added when
their score, moved by context words, reaches the threshold: iban (mod-97), local_phone and ssn where they overlap no base
span, secret anywhere. A secret is the value that a name such as token or password is given, a key of a known format, or
a block with a private key; what confirms it is a checksum where the format has one, a readable header, or the entropy
of its characters. Offsets are code points, ends exclusive. Every scan is linear in the text's length.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone", "ssn", "secret")
THRESHOLD = 0.6
#: Score before context, then the words that raise it; the window is this many characters on either side.
WINDOW, RAISE, LOWER = 48, 0.35, 0.35
SCORES = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.35, "ssn": 0.35, "secret": 0.55}
#: Of secrets that a format or a block confirms, without any context.
FORMAT_SCORE = 0.9
CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|cuenta|compte)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "secret": re.compile(r"(?:token|secret|key|passw|pwd|credential|auth|bearer|login)", re.I),
}
AGAINST = re.compile(r"\b(?:isbn|issn|version|invoice|order no|serial|example)\b", re.I)

_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that fails from its start fails from anywhere inside, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# A name, a sign, a value. Values end at white space, quotes and list marks.
_ASSIGNED = re.compile(r"""(?i)(token|secret|password|passwd|pwd|credential|api[_-]?key|access[_-]?key|private[_-]?key)s?["']?[\x20\t]{0,4}(?::=|=>|=|:)[\x20\t]{0,4}["']?([^\s"'`<>,;(){}\[\]]{8,512})""")
_KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z]{1,10} ){0,3}PRIVATE KEY)-----")
_FORMATS = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{2,4000}\.[A-Za-z0-9_-]{16,1000})(?![A-Za-z0-9_-])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: One of these, in lower case, is in every text with a secret: looked for before the slower patterns.
_SECRET_HINTS = ("token", "secret", "passw", "pwd", "credential", "key", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyj")
#: Least bits a character, and least characters, of a random value.
ENTROPY, RANDOM_CHARS = 3.0, 16

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterator[Span]:
    """Proposals that pass the checksum, whole or up to one of their spaces, as a word or number may follow; the longest counts."""
    m = _IBAN.search(text)
    while m:
        end = m.end()
        while end > m.start() and not (15 <= len(i := text[m.start() : end].replace(" ", "")) <= 34 and mod97(i)):
            end = text.rfind(" ", m.start(), end)
        if end > m.start():
            yield "iban", m.start(), end
        m = _IBAN.search(text, max(end, m.start() + 1))


def entropy(value: str) -> float:
    """Bits a character, by the value's own frequencies."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _known_format(value: str) -> bool:
    """Checksum or header of a key of a known format."""
    if value.startswith("gh"):  # the last six characters are the CRC-32 of those between prefix and checksum
        n, body = zlib.crc32(value[4:-6].encode()), ""
        for _ in range(6):
            n, k = divmod(n, 62)
            body = _BASE62[k] + body
        return body == value[-6:]
    if value.startswith("eyJ"):
        head = value.split(".")[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except (ValueError, binascii.Error, RecursionError):
            return False
    return entropy(value) >= ENTROPY


def _confirmed(name: str, value: str) -> bool:
    """Whether an assigned value looks like a secret: random, or a password of several kinds of characters."""
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    if name.lower().startswith(("pass", "pwd")):
        return kinds >= 2 and len(set(value)) >= 5
    return len(value) >= RANDOM_CHARS and kinds >= 2 and bool(re.search("[0-9]", value)) and entropy(value) >= ENTROPY


def secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score before context) of confirmed values, no two overlapping: the leftmost, then the longest."""
    found = [(*m.span(2), SCORES["secret"]) for m in _ASSIGNED.finditer(text) if _confirmed(m[1], m[2])]
    found += [(*m.span(), FORMAT_SCORE) for m in _FORMATS.finditer(text) if _known_format(m[0])]
    if "-----BEGIN" in text:
        for m in _KEY_BLOCK.finditer(text):
            end = text.find(f"-----END {m[1]}-----", m.end(), m.end() + 20_000)
            found.append((m.start(), m.end() if end < 0 else end + len(m[0]) - 2, FORMAT_SCORE))
    done = 0
    for start, end, value in sorted(found, key=lambda x: (x[0], -x[1], -x[2])):
        if start >= done:
            yield start, end, value
            done = end


def base_spans(text: str) -> list[Span]:
    found = list(emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def score(text: str, kind: str, start: int, end: int, before: float | None = None) -> float:
    """Score of a confirmed span after its context; base kinds never fall below the threshold."""
    around = f"{text[max(0, start - WINDOW) : start]} | {text[end : end + WINDOW]}"
    value = (SCORES[kind] if before is None else before) + RAISE * bool(CONTEXT[kind].search(around)) - LOWER * bool(AGAINST.search(around))
    return round(min(1.0, max(THRESHOLD if kind in BASE else 0.0, value)), 4)


def find(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by kind, then start; null and empty texts have none."""
    if not text:
        return []
    base = base_spans(text)
    found = [(k, s, e, score(text, k, s, e), True) for k, s, e in base]
    if _DIGIT.search(text):
        more = list(ibans(text))
        more += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        more += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        for k, s, e in more:
            if (v := score(text, k, s, e)) >= THRESHOLD and not any(s < e2 and s2 < e for _, s2, e2 in base):
                found.append((k, s, e, v, False))
    low = text.lower()
    if any(h in low for h in _SECRET_HINTS):
        found += [("secret", s, e, v, False) for s, e, before in secrets(text) if (v := score(text, "secret", s, e, before)) >= THRESHOLD]
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of docs, in any order.

    A null or empty text has an empty array. Ids are passed through as they are, null and repeated ones too. Texts are
    scanned whole. Other columns of docs are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "score", "base")
        for b in batches:
            spans = [[dict(zip(names, x, strict=True)) for x in find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _ARROW)], names=["id", "spans"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, spans {SPANS}")


def redact(text: str | None, mask: str = "<{}>") -> str | None:
    """The text with every span replaced by its kind; a null stays null."""
    if not text:
        return text
    out, done = [], 0
    for kind, start, end, *_ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if start >= done:
            out += [text[done:start], mask.format(kind.upper())]
            done = end
    return "".join(out) + text[done:]


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["base"])
    return found.select(F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("secret").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"), F.array_max(F.transform("spans", lambda x: x["score"])).alias("max_score"))
