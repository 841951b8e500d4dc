"""Plain versions of the contracts, a document at a time."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def substring(rows, width=20):
    """rows: (doc_id, text); null ids last."""
    words = [(i if i is not None else 1 << 63, i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for key, _, w in words:
        for p in range(len(w) - width + 1):
            x = tuple(w[p:p + width])
            first[x] = min(first.get(x, (key, p)), (key, p))
    out = []
    for key, i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < (key, p):
                gone.update(range(p, p + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    return out


def suffix(rows, width=50):
    texts = [(i if i is not None else 1 << 63, i, (t or "").encode()) for i, t in rows]
    first = {}
    for key, _, b in texts:
        for p in range(len(b) - width + 1):
            x = b[p:p + width]
            first[x] = min(first.get(x, key), key)
    out = []
    for key, i, b in texts:
        flag = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < key:
                flag[p:p + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(flag)))
        out.append((i, len(b), sum(flag), spans, sha(bytes(x for x, f in zip(b, flag) if not f))))
    return out


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, size):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def near(rows, size, percent):
    """rows: (doc_id, text); rows that share an id are one document."""
    sets = [(i if i is not None else 1 << 63, i, shingle_set(t, size)) for i, t in rows]
    parent = {key: key for key, _, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, (a, _, s) in enumerate(sets):
        for b, _, t in sets[:n]:
            common = len(s & t)
            if common and 100 * common >= percent * (len(s) + len(t) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    real = lambda k: None if k == 1 << 63 else k
    return [(i, len(s), real(find(key)), find(key) == key) for key, i, s in sets]


def chat(rows):
    """rows: (conv_id, turn, role, text) in order of turns."""
    out = {}
    for conv, _, role, text in rows:
        out.setdefault(conv, []).append((role or "", text or ""))
    result = []
    for conv, turns in out.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        result.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)))
    return result


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def private(text):
    text = text or ""

    def luhn(digits):
        total = 0
        for n, d in enumerate(reversed(digits)):
            d = int(d) * (2 if n % 2 else 1)
            total += d - 9 if d > 9 else d
        return total % 10 == 0
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15))
    return [(k, m.start(), m.end()) for k, p, good in kinds for m in re.finditer(p, text) if good(m[0])]


def licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
             for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def contained(docs, items, size=5, percent=80):
    sets = [(i, shingle_set(t, size)) for i, t in items]
    out = []
    for d, t in docs:
        have = set().union(*(shingle_set(t, n) for n in range(1, size + 1)))
        for i, s in sets:
            if s and 100 * len(s & have) >= percent * len(s):
                out.append((d, i, len(s), len(s & have)))
    return out


def private_more(text):
    """Spans of the kinds beyond the base, each from one pattern of its own over the whole text."""
    def iban(m):
        m = m.replace(" ", "").upper()
        return 15 <= len(m) <= 34 and int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97 == 1

    def ssn(m):
        m = re.sub("[^0-9]", "", m)
        return m[:3] != "000" and m[:3] != "666" and m[0] != "9" and m[3:5] != "00" and m[5:] != "0000"

    def routing(m):
        d = [int(c) for c in m]
        return any(d) and (3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]) % 10 == 0
    label = r"(?: (?:[Nn]umber|NUMBER|[Nn]o|NO))?\.?[:#]? {0,2}(?:is )?#?"
    cue = lambda words: rf"(?<![^\W_])(?i:{words}){label}"
    street = "street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|square|sq|terrace|highway|hwy|parkway|pkwy"
    kinds = (("url", r"((?i:https?://|ftp://)[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?)", lambda m: True),
             ("secret", r"(?i:password|passwd|token|secret|api_key|apikey|api-key|access_key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,})",
              lambda m: re.search("[0-9]", m)),
             ("iban", r"(?i:iban)[: ]{0,3}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])", iban),
             ("address", rf"([0-9]{{1,5}}(?: [A-Z][a-z]+){{1,3}} (?=[A-Z])(?i:{street})(?![^\W_]))", lambda m: True),
             ("ssn", cue("ssn|social security") + r"([0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4})(?![0-9A-Za-z])", ssn),
             ("account", cue("account|acct") + r"([0-9]{8,17})(?![0-9A-Za-z])", lambda m: True),
             ("routing", cue("routing|aba") + r"([0-9]{9})(?![0-9A-Za-z])", routing))
    return [(k, m.start(1), m.end(1)) for k, p, good in kinds for m in re.finditer(p, text or "") if good(m[1])]
