"""Operator 2: personal data.

Patterns propose spans, validators confirm them (parts of an address at most
255, Luhn for cards, mod-97 for account numbers, digit counts), and context
words close before a span move its score. Confirmed base kinds (email, ip,
card, phone) always stay; the kinds the method adds (iban, ssn, secret) need a score
of ``ACCEPT`` and must not overlap a base span. A secret is an unbroken run of at least
20 key characters, letters and digits mixed, of at least ``ENTROPY`` bits a character; it needs a
key word before it or the beginning of a known key format.

Every text is scanned whole and in one pass per pattern; no pattern restarts
inside a run of its own characters, so very long texts stay linear. There is
no shuffle: a hot source costs what its rows cost.

Defined results: null and empty texts have no spans; repeated rows are judged
each; no rows give no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
ORDER = {k: n for n, k in enumerate(KINDS)}
ACCEPT = 0.6
ENTROPY = 3.0

# The base patterns. An atomic digit run cannot match from its middle
# once its start has failed, so a look-behind changes nothing but the time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
KEY_FORMAT = re.compile(r"AKIA|ASIA|gh[opsu]_|github_pat_|glpat-|sk[-_]|xox[abps]-|AIza|eyJ")  # fixed values: public key formats

# Start score of each kind, and what a context word within CONTEXT characters before adds.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.35, "secret": 0.3}
CONTEXT = 40
WORDS = {
    "email": {"email": 0.1, "mail": 0.1, "contact": 0.05},
    "ip": {"ip": 0.2, "address": 0.1, "host": 0.1, "version": -0.4, "section": -0.3},
    "card": {"card": 0.2, "visa": 0.2, "credit": 0.2, "order": -0.2, "isbn": -0.4},
    "phone": {"phone": 0.2, "call": 0.2, "tel": 0.2, "mobile": 0.2, "fax": 0.1},
    "iban": {"iban": 0.2, "account": 0.1, "bank": 0.1, "konto": 0.1},
    "ssn": {"ssn": 0.5, "social": 0.4, "security": 0.3, "part": -0.2},
    "secret": {"token": 0.4, "secret": 0.4, "password": 0.4, "passwd": 0.4, "pwd": 0.4, "key": 0.3, "apikey": 0.4, "api": 0.1,
               "auth": 0.3, "bearer": 0.4, "credential": 0.4, "credentials": 0.4, "commit": -0.3, "sha": -0.3, "checksum": -0.4},
}
_WORD = re.compile(r"[a-z]+")

SPANS_TYPE = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    s = account.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping addresses, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1  # no local part can reach over an @
        at = text.find("@", done)


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if _ip_ok(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def random_key(run: str) -> bool:
    """Whether a run mixes letters and digits and its characters are spread as a random key's are."""
    if run.isdigit() or not any("0" <= c <= "9" for c in run) or not any(c.isalpha() for c in run):
        return False
    return sum(n * math.log2(len(run) / n) for n in Counter(run).values()) >= ENTROPY * len(run)


def added_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    for m in IBAN.finditer(text):
        if m.start() and text[m.start() - 1].isalnum():
            continue
        whole = m[0]
        while len(whole) >= 15:  # a following capital word may have joined the run
            if mod97(whole) and not text[m.start() + len(whole):][:1].isalnum():
                out.append(("iban", m.start(), m.start() + len(whole)))
                break
            whole = whole[:whole.rfind(" ")] if " " in whole else ""
    for m in SSN.finditer(text):
        a, b = m.span()
        if not (text[a - 1:a].isdigit() or text[b:b + 1].isdigit()) and m[0][:3] not in ("000", "666") and m[0][0] != "9":
            out.append(("ssn", a, b))
    out += [("secret", *m.span()) for m in SECRET.finditer(text) if random_key(m[0])]
    return [s for s in out if all(s[2] <= t[1] or t[2] <= s[1] for t in taken)]


def score(kind: str, start: int, text: str) -> float:
    near = set(_WORD.findall(text[max(0, start - CONTEXT):start].lower()))
    known = 0.4 if kind == "secret" and KEY_FORMAT.match(text, start) else 0.0
    return round(min(1.0, max(0.0, START[kind] + known + sum(v for w, v in WORDS[kind].items() if w in near))), 3)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, kind, end; offsets in code points, end exclusive."""
    text = text or ""
    base = base_spans(text)
    spans = [(*s, score(s[0], s[1], text)) for s in base]
    spans += [(*s, v) for s in added_spans(text, base) if (v := score(s[0], s[1], text)) >= ACCEPT]
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def redact(text: str | None) -> str | None:
    """Spans replaced by ``<KIND>``; spans that overlap become one mark, of the first."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans`` (array of kind, start, end, score) for every row."""
    def run(batches):
        for b in slices(batches, text=1):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], [id_col, "spans"])

    df = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    kind = df.schema[id_col].dataType.simpleString()
    return df.mapInArrow(run, f"`{id_col}` {kind}, spans {SPANS_TYPE}")


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows and columns with the spans of ``text_col`` replaced; ``length_col`` follows where a text changed."""
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(length_col) if length_col else None

    def run(batches):
        for b in slices(batches, text=at):
            before = b.column(at).to_pylist()
            after = [redact(t) for t in before]
            b = b.set_column(at, b.schema.field(at), pa.array(after, b.schema.field(at).type))
            if size_at is not None:
                sizes = [n if x == y else len(y) for n, x, y in zip(b.column(size_at).to_pylist(), before, after)]
                b = b.set_column(size_at, b.schema.field(size_at), pa.array(sizes, b.schema.field(size_at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))))


def op2_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = {k: F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in KINDS}
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count[k] for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"), *[count[k] for k in KINDS[len(BASE_KINDS):]],
                        F.size("spans").cast("long").alias("n_spans"))
