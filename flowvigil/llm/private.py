"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits, schemes
and the cue words of identifiers and addresses. A small parser for each kind expands from the
anchor, to the left and right as far as the kind's characters go, and validates what it got. Cues
count in any letter case.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowvigil.llm.tasks import map_blocks

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "iban", "address", "ssn", "account", "routing")
# Cues of the kinds beyond the base, in lower case.
CUES = {
    "url": ("http://", "https://", "ftp://"),
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey", "api-key", "access_key"),
    "iban": ("iban",),
    "address": tuple(f" {w}" for w in ("street", "st", "avenue", "ave", "road", "rd", "boulevard", "blvd", "lane", "ln", "drive", "dr", "court", "ct",
                                       "square", "sq", "terrace", "highway", "hwy", "parkway", "pkwy")),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct"),
    "routing": ("routing", "aba"),
}
# Cues that count only as a word of their own.
WHOLE = ("ssn", "account", "routing")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9.-]+(:[0-9]+)?([/?#][^\s\"'<>]*)?")
SECRET = re.compile(r"\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,})")
IBAN = re.compile(r"[:\x20]{0,3}([A-Za-z]{2}[0-9]{2}(\x20?[A-Za-z0-9]{4}){2,7}(\x20?[A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])")
# What may stand between a cue and its number.
LABEL = r"(?:\x20(?:[Nn]umber|NUMBER|[Nn]o|NO))?\.?[:#]?\x20{0,2}(?:is\x20)?#?"
SSN = re.compile(LABEL + r"([0-9]{3}[\x20-]?[0-9]{2}[\x20-]?[0-9]{4})(?![0-9A-Za-z])")
ACCOUNT = re.compile(LABEL + r"([0-9]{8,17})(?![0-9A-Za-z])")
ROUTING = re.compile(LABEL + r"([0-9]{9})(?![0-9A-Za-z])")
STREET = re.compile(r"[0-9]{1,5}(\x20[A-Z][a-z]+){1,3}$")


_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def lowered(text: str) -> str:
    """A-Z in lower case; every other character stays, so places stay too."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


@functools.lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for cue, kind in (("@", "email"), ("+", "phone"), *((c, kind) for kind, cues in CUES.items() for c in cues)):
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(part := x.lstrip("0")) <= 3 and int(part or 0) <= 255 for x in text.split("."))


def is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 8 <= sum(c in DIGITS for c in text) <= 15


def is_iban(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def is_ssn(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def is_routing(text: str) -> bool:
    return sum(int(c) * w for c, w in zip(text, (3, 7, 1) * 3)) % 10 == 0 and text != "000000000"


NUMBERS = {"iban": (IBAN, is_iban), "ssn": (SSN, is_ssn), "account": (ACCOUNT, lambda text: True), "routing": (ROUTING, is_routing)}


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of KINDS, then by start.

    The base kinds are the leftmost matches of their patterns that do not overlap; one that
    fails its check is dropped and the search goes on behind it.
    """
    out: dict[str, list[tuple[str, int, int]]] = {}
    after = dict.fromkeys(KINDS, 0)

    def take(kind, start, end, good=True):
        after[kind] = end
        if good:
            out.setdefault(kind, []).append((kind, start, end))

    for last, (cue, size) in automaton().iter(lowered(text)):
        start = last - size + 1
        if cue == "digit":
            if start and text[start - 1] in DIGITS:
                continue  # inside a run of digits: the parsers saw its start
            for kind, pattern, check in (("ip", IP, is_ip), ("card", CARD, is_card)):
                if start >= after[kind] and (m := pattern.match(text, start)):
                    take(kind, start, m.end(), check(m[0]))
        elif cue == "email":
            begin = start
            while begin > after["email"] and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < start and (m := DOMAIN.match(text, last + 1)):
                take("email", begin, m.end())
        elif start < after[cue] or (cue in WHOLE and start and text[start - 1].isalnum()):
            continue
        elif cue == "phone":
            if m := PHONE.match(text, start):
                take("phone", start, m.end(), is_phone(m[0]))
        elif cue == "url":
            if m := URL.match(text, last + 1):
                take("url", start, m.end())
        elif cue == "secret":
            if m := SECRET.match(text, last + 1):
                take("secret", m.start(1), m.end(1), any(c in DIGITS for c in m[1]))
        elif cue in NUMBERS:
            pattern, check = NUMBERS[cue]
            if m := pattern.match(text, last + 1):
                take(cue, m.start(1), m.end(1), check(m[1]))
        elif text[start + 1].isupper() and not text[last + 1:last + 2].isalnum():
            if m := STREET.search(text, max(after["address"], start - 70), start):
                take("address", m.start(), last + 1)
    return [span for kind in KINDS for span in out.get(kind, ())]


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end), for the whole text of each row.

    A null or empty text has none; rows with the same doc_id, or equal rows, are looked at each on its own;
    texts of any length are looked at whole; other columns are not looked at; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(block):
        rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t)] if t else [] for t in block["text"].to_pylist()]
        return pa.table({"doc_id": block["doc_id"], "spans": pa.array(rows, kind)})
    return map_blocks(docs.select("doc_id", "text"), run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def mask_text(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    found = sorted(spans(text), key=lambda s: (s[1], -s[2]))
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if found else text


def redact(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` replaced by its kind; a null text stays null.

    The other columns may have any names; they go through the tasks by position.
    """
    at = docs.columns.index("text")
    named = docs.toDF(*("text" if i == at else f"c{i}" for i in range(len(docs.columns))))

    def run(block):
        new = pa.array([None if t is None else mask_text(t) for t in block["text"].to_pylist()], block["text"].type)
        return pa.Table.from_batches([block]).set_column(at, "text", new)
    return map_blocks(named, run, named.schema).toDF(*docs.columns)


def span_strings(found: DataFrame) -> DataFrame:
    """Spans as text: doc_id, a count for each base kind, ``base`` and ``spans`` as kind:start:end joined by commas."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE_KINDS), joined(base).alias("base"), joined(F.col("spans")).alias("spans"))
