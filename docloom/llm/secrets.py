"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of key characters with a digit, what a name with a naming word is assigned (in quotes: all up to the closing one on
its line, spaces too), the password of a URL, what follows "bearer", a known shape of keys, or a private-key block (to its end line, or where that is missing as far as lines of key characters go). The
forest sees its length, character classes and transitions, entropy, how much of it a dictionary covers, whether it
looks like a path, URL, UUID or placeholder, and the words next to it. It is trained from labelled findings; the ones
shipped are generated by labelled_findings() from a fixed seed, others may be given.

Defined results: null text is empty and has no findings; each finding of each row is one row, with its place in code
points; repeated rows repeat their findings; null ids stay null; an empty table gives an empty result; other columns are
ignored by find(), and kept by redact(), which leaves null texts null and sets n_chars where there is such a column.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_batches, texts_of

MASK = "[SECRET]"
CUT = 0.5
TREES, DEPTH, LEAF = 40, 9, 2
FINDINGS = 3000
#: Characters of the line before a candidate, and half as many after it, in which neighbouring words are looked up.
NEAR = 48

_KEY = r"A-Za-z0-9+/=_.~\-"
_RUN = re.compile(rf"(?<![{_KEY}])(?=[A-Za-z+/=_.~\-]*[0-9])[{_KEY}]{{12,}}")
_ASSIGN = re.compile(r"(?<![\w.\-])([\w.\-]+)[\"']?\s*(?:=>|[:=])\s*[\"']?")
_VALUE = re.compile(r"[^\s\"'<>,;]{6,}")
_BEGUN = re.compile(r"[^\s\"'<>,;]{6}")
# A name may have words before the naming word, and after it more words behind an underscore, hyphen, digit or capital.
_NAMING = re.compile(r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|bearer|credentials?)(?:s|[_A-Z0-9-][\w-]*)?$")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*=(?!=)")
_SHAPE = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{8,}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{8,})"
)
_URL = re.compile(r"://[^\s/@:\"'<>]*:([^\s/@\"'<>]{4,})@")
_BEARER = re.compile(r"(?i:(?<![A-Za-z])bearer)[ \t]+([A-Za-z0-9._~+/=\-]{12,})")
_PEM = re.compile(r"-----(BEGIN|END) ([A-Z ]*PRIVATE KEY)-----")
_PEM_LINES = re.compile(r"(?:(?:\s|\\[nr]){0,4}[A-Za-z0-9+/]{16,}={0,2})*")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HOLD = re.compile(r"(?i)(?:x{4,}|\*{3,}|example|sample|dummy|placeholder|change.?me|your[_-]|<.*>|\.\.\.|test.?(?:key|token)|redacted)")
_FOR = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|credential|auth|bearer|login)")
_AGAINST = re.compile(r"(?i)(?:commit|revision|sha-?\d*|md5|checksum|digest|hash|uuid|guid|etag|version|build|image|base64,|file|path|https?|www|phone|call|card|isbn|order|invoice|page|figure|table)")
_MADE = re.compile(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^sk[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}$|^xox[abprs]-|^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.|^AIza[A-Za-z0-9_-]{30,}$|^glpat-")
# A small dictionary: words that identifiers, paths and prose are made of.
_WORDS = frozenset(
    "about account action active address admin after again agent align allow alpha array article asset author auto back base batch before begin best beta body book border bottom box branch build button cache call card center change "
    "chapter check child class clean click client close cloud code color column com commit common config content control copy core count create current custom data date default delete demo desk detail device dev dialog disk display docs "
    "document domain down download draft edit email empty enable end engine entry error event example export extra false feature field file filter final find first font form format frame from full function game get global group guide "
    "head height help hidden high history home host html http image import index info init input install item java job json key label large last layer left length level library license light line link list live load local log login long "
    "lower mail main make manager map master media member menu message method mobile mode model module month move name net new next node none note number object offer office online open option order org other output package page panel "
    "parent part password path patch people photo place play plugin point policy port post press price print private product profile project public query read ready record release remove report request reset result return right role root "
    "route row rule run sample save scale school screen script search section select server service session set share shop show side sign simple single site size small sort source space start state static status step stop store string "
    "style submit summary support system table target task team template test text theme this thread thumb time title token tool top track true type under update upload url user util value version video view web week white wide width "
    "window with word work world write www xml year your the and for that tion ing ent".split()
)
NAMES = (
    "length", "digits", "upper", "lower", "symbols", "transitions", "entropy", "hexadecimal", "dictionary", "slashes", "dots", "uuid", "held", "made", "for", "against", "assigned", "quoted", "all_digits", "longest_run", "sequence", "named", "url",
)


def _gaps(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that no taken one covers; taken is sorted and free of overlaps."""
    for s, e in taken[max(0, bisect_left(taken, (start, start)) - 1) :]:
        if s >= end:
            break
        if e > start:
            if s > start:
                yield start, s
            start = e
    if start < end:
        yield start, end


def _naming(m: re.Match | None) -> bool:
    return m is not None and _NAMING.search(m[1].rsplit(".", 1)[-1]) is not None


def _assigned(text: str) -> Iterator[tuple[int, int, int]]:
    """(start of the name, start, end) of what naming names are assigned; where that is itself an assignment by such a name, its own."""
    done = 0
    unclosed: set[str] = set()  # quotes of which no further one follows
    for m in _ASSIGN.finditer(text):
        if m.start() < done or not _naming(m):
            continue
        inner = _ASSIGN.match(text, m.end())
        if _naming(inner) and _BEGUN.match(text, inner.end()):
            continue
        quote = text[m.end() - 1]
        if quote in "\"'" and quote not in unclosed:
            end = text.find(quote, m.end())
            if end < 0:
                unclosed.add(quote)
            elif end - m.end() >= 6 and text.find("\n", m.end(), end) < 0 and " " in text[m.end() : end].strip():
                done = end
                yield m.start(), m.end(), done
                continue
        if value := _VALUE.match(text, m.end()):
            done = value.end()
            yield m.start(), value.start(), done


def _blocks(text: str) -> list[tuple[int, int]]:
    """Private-key blocks: an end line belongs to the last begin line before it, if that is of the same kind."""
    out: list[tuple[int, int]] = []
    begun = None
    for m in _PEM.finditer(text):
        if m[1] == "END":
            if begun and begun[2] == m[2]:
                out.append((begun.start(), m.end()))
                begun = None
            continue
        if begun:
            out.append((begun.start(), _PEM_LINES.match(text, begun.end(), m.start()).end()))
        begun = m
    if begun:
        out.append((begun.start(), _PEM_LINES.match(text, begun.end()).end()))
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of non-overlapping candidates in order; key blocks, named values and known shapes come before runs."""
    out = [(*span, "private_key") for span in _blocks(text)] if "PRIVATE KEY-----" in text else []
    taken = [c[:2] for c in out]
    if "=" in text or ":" in text:
        blocks = list(taken)
        for name, s, e in _assigned(text):
            if list(_gaps(s, e, blocks)) == [(s, e)]:
                out.append((s, e, "assigned"))
                taken += _gaps(name, e, blocks)
        taken.sort()
    if "://" in text:
        urls = [m.span(1) for m in _URL.finditer(text)]
        urls = [c for c in urls if list(_gaps(*c, taken)) == [c]]
        out += [(*c, "url") for c in urls]
        taken = sorted(taken + urls)
    shapes = sorted([m.span() for m in _SHAPE.finditer(text)] + [m.span(1) for m in _BEARER.finditer(text)])
    shapes = [c for k, c in enumerate(shapes) if not k or c[0] >= max(x[1] for x in shapes[k - 1 : k])]
    shapes = [c for c in shapes if list(_gaps(*c, taken)) == [c]]
    out += [(*c, "run") for c in shapes]
    taken = sorted(taken + shapes)
    for m in _RUN.finditer(text):
        for s, e in _gaps(*m.span(), taken):
            last = next((k for k in range(e - 1, s - 1, -1) if text[k] in string.digits), -1)
            if e - s < 12 or last < 0:
                continue
            while (name := _NAME.match(text, s, e)) and e - name.end() >= 12 and last >= name.end():
                s = name.end()
            out.append((s, s + len(text[s:e].rstrip(".=-") or text[s:e]), "run"))
    return sorted(out)


def _dictionary(value: str) -> float:
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        for n in range(min(10, len(low) - at), 2, -1):
            if low[at : at + n] in _WORDS:
                covered, at = covered + n, at + n
                break
        else:
            at += 1
    return covered / max(1, len(low))


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    value = text[start:end]
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in value]
    count = Counter(kinds)
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR // 2]
    near = before.rsplit("\n", 1)[-1]
    run = longest = 1
    steps_ = 0
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
        steps_ += ord(b) - ord(a) == 1
    return [
        float(min(len(value), 200)), count["d"] / n, count["u"] / n, count["l"] / n, count["s"] / n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        -sum(c / n * math.log2(c / n) for c in Counter(value).values()), float(all(c in string.hexdigits for c in value)), _dictionary(value),
        value.count("/") / n * 10, value.count(".") / n * 10, float(bool(_UUID.fullmatch(value))), float(bool(_HOLD.search(value))), float(bool(_MADE.search(value))) + 2 * (kind == "private_key"),
        float(bool(_FOR.search(near))), float(bool(_AGAINST.search(near)) or bool(re.match(r"(?i)\W*(?:commit|checksum|revision)", after))), float(bool(re.search(r"[:=]\s*[\"']?$", near))),
        float(near[-1:] in "\"'" and near != ""), float(value.isdigit()), longest / n, steps_ / n, float(kind in ("assigned", "url")), float(bool(re.search(r"(?i)(?:https?:/|www\.|@)\S*$", near)) or "://" in value),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, secret) of generated findings, about half of them secrets."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    lower_, hexa, b64 = string.ascii_lowercase, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: r.choice(sorted(_WORDS)) if r.random() < 0.5 else pick("aeiou", 1) + pick(lower_, r.randint(1, 6)) + pick("aeiou", 1)
    prose = lambda k: " ".join(word() for _ in range(k))
    named = ("token", "api_key", "apikey", "secret", "password", "access_key", "client_secret", "auth_token", "SECRET_KEY", "passwd", "private_key", "credential")
    secrets = (
        lambda: pick(hexa, r.choice((32, 40, 40, 48, 64))), lambda: pick(hexa, r.choice((32, 40, 64))).upper(), lambda: pick(b64, r.choice((24, 32, 40, 44, 64, 88))), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + pick(string.ascii_letters + string.digits, 36), lambda: "sk_live_" + pick(string.ascii_letters + string.digits, 24), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(string.ascii_letters + string.digits, 24),
        lambda: "eyJ" + pick(b64[:-2], 20) + "." + pick(b64[:-2], 40) + "." + pick(b64[:-2], 43), lambda: pick(string.ascii_letters + string.digits + "!#%&", r.randint(10, 18)), lambda: word().capitalize() + str(r.randint(10, 9999)) + r.choice("!#%") + pick(lower_, 3),
        lambda: word() + pick(string.digits, r.randint(1, 3)) + word(),
    )
    schemes = ("postgres", "mysql", "redis", "amqp", "https", "ftp", "mongodb+srv")
    phrase = lambda: " ".join(word() if r.random() < 0.5 else pick(lower_, r.randint(3, 8)) for _ in range(r.randint(2, 5))) + r.choice(("", "", pick(string.digits, 2), "!"))
    sentence = lambda: prose(r.randint(6, 14)).capitalize() + r.choice((".", ", " + prose(3) + "."))
    others = (
        lambda: (r.choice(("commit ", "Revision: ", "merged commit ")), pick(hexa, 40)), lambda: (r.choice(("md5: ", "sha1sum ", "checksum = ", "sha256: ", "ETag: ")), pick(hexa, r.choice((32, 40, 64)))),
        lambda: (r.choice(("id=", "uuid: ", "request ", "guid ")), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))), lambda: ("see https:", "//www." + word() + ".com/" + "/".join(word() for _ in range(3)) + "/" + pick(string.digits, 4)),
        lambda: ("in ", "/" + "/".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)) + r.choice((".html", ".txt", ".py", ".jpg"))), lambda: ("", word().capitalize() + word().capitalize() + word().capitalize() + str(r.randint(1, 99))),
        lambda: ("version ", ".".join(str(r.randint(0, 40)) for _ in range(4)) + "-" + word() + str(r.randint(0, 9))), lambda: ("", pick(string.digits, r.choice((12, 13, 16)))), lambda: ("call ", "+1-" + pick(string.digits, 3) + "-" + pick(string.digits, 3) + "-" + pick(string.digits, 4)),
        lambda: ("data:image/png;base64,", pick(b64, r.choice((60, 120)))), lambda: (r.choice(named) + " = ", r.choice(("xxxxxxxxxxxxxxxx", "your_api_key_here1", "changeme123456", "example-token-1234", "<your-token-here>", "************"))),
        lambda: ("", "_".join(word() for _ in range(4)) + "_" + str(r.randint(1, 9))), lambda: (word() + ".", pick(string.digits, 2) + "." + word() + str(r.randint(0, 9)) + ".example.com"), lambda: (r.choice(named) + ": ", "_".join(word() for _ in range(3))),
        lambda: ("", "2" + pick(string.digits, 3) + "-0" + pick("123456789", 1) + "-1" + pick(string.digits, 1) + "T12:00:00"[:9]), lambda: (word() + "@mail", pick(string.digits, 1) + ".example.com." + word()),
    )
    out = []
    while len(out) < n:
        if r.random() < 0.5:
            q = r.choice(('"', "'", ""))
            lead = r.choice(named) + r.choice((" = ", "=", ": ", ":")) if r.random() < 0.85 else r.choice(("", "use ", "with key "))
            value, kind, secret = r.choice(secrets)(), "assigned" if lead.endswith(("=", " ", ":")) and lead not in ("", "use ", "with key ") else "run", 1
            if kind == "run" and not _MADE.search(value):
                value = pick(b64, 40)
            if r.random() < 0.08:
                lead, q, kind = r.choice(("Bearer ", "Authorization: Bearer ", "bearer ")), "", "run"
                value = r.choice((lambda: pick(string.ascii_letters, r.randint(16, 48)), lambda: pick(b64[:-2] + "-_", r.randint(20, 60))))()
            head, tail = prose(r.randint(0, 8)) + " " + lead + q, q + " " + prose(r.randint(0, 8))
            rare = r.random()
            if rare < 0.06:  # a passphrase in quotes
                q, kind, value = r.choice(('"', "'")), "assigned", phrase()
                head, tail = prose(r.randint(0, 8)) + " " + r.choice(("password", "passphrase", "db_password", "secret", "DB_PASSWORD")) + r.choice((" = ", "=", ": ")) + q, q + " " + prose(r.randint(0, 8))
            elif rare < 0.14:  # the password of a URL
                kind, value = "url", r.choice((lambda: pick(string.ascii_letters + string.digits, r.randint(8, 24)), lambda: word() + pick(string.digits, 2) + word(), lambda: pick(hexa, 32)))()
                head, tail = prose(r.randint(0, 8)) + " " + r.choice(schemes) + "://" + word() + ":", "@" + word() + r.choice((".example.com", ".local:5432/" + word(), "/" + word()))
        elif r.random() < 0.08:
            if r.random() < 0.5:  # a sentence in quotes
                q, kind, secret, value = '"', "assigned", 0, sentence()
                head, tail = prose(r.randint(0, 8)) + " " + r.choice(("token", "secret", "password", "credentials")) + r.choice((": ", " = ")) + q, q + " " + prose(r.randint(0, 8))
            else:  # what stands for a password in a URL
                kind, secret, value = "url", 0, r.choice(("password", "PASSWORD", "pass", "secret", "passwd", "your_password", "xxxxxxxx", "********", "${DB_PASSWORD}", "changeme", "<password>"[1:-1]))
                head, tail = prose(r.randint(0, 8)) + " " + r.choice(schemes) + "://" + r.choice(("user", "USER", word())) + ":", "@" + word() + ".example.com"
        else:
            lead, value = r.choice(others)()
            kind, secret = "assigned" if any(_assigned(lead + value)) else "run", 0
            head, tail = prose(r.randint(0, 8)) + " " + lead, " " + prose(r.randint(0, 8))
        out.append((head + value + tail, len(head), len(head) + len(value), kind, secret))
    return out


class Forest:
    """Classification trees on bootstrap samples; each split looks at a random few of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x[i], y[i], depth, leaf, rng) for i in (rng.integers(0, len(x), len(x)) for _ in range(trees))]

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def node(rows: np.ndarray, d: int) -> int:
            at = len(feature)
            own = y[rows]
            for column, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, own.mean())):
                column.append(v)
            if d == 0 or len(rows) < 2 * leaf or own.min() == own.max():
                return at
            best = (1e-9, -1, 0.0)
            whole = own.mean() * (1 - own.mean()) * len(rows)
            for k in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
                order = np.argsort(x[rows, k], kind="stable")
                v, s = x[rows[order], k], np.cumsum(own[order])
                n = np.arange(1, len(rows))
                ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(rows) - n >= leaf)
                if not ok.any():
                    continue
                a, b = s[:-1], s[-1] - s[:-1]
                m = len(rows) - n
                gain = np.where(ok, whole - a * (1 - a / n) - b * (1 - b / m), -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(k), float((v[i] + v[i + 1]) / 2))
            if best[1] >= 0:
                feature[at], cut[at] = best[1], best[2]
                low = x[rows, best[1]] <= best[2]
                left[at] = node(rows[low], d - 1)
                right[at] = node(rows[~low], d - 1)
            return at

        node(np.arange(len(x)), depth)
        return tuple(map(np.array, (feature, cut, left, right, value)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                low = x[i, feature[at[i]]] <= cut[at[i]]
                at[i] = np.where(low, left[at[i]], right[at[i]])
            total += value[at]
        return total / len(self.trees)


def train(findings: list[tuple[str, int, int, str, int]]) -> Forest:
    return Forest(np.array([features(*f[:4]) for f in findings]), np.array([float(f[4]) for f in findings]))


@lru_cache(1)
def shipped() -> Forest:
    """The forest of the generated findings, fitted once a process."""
    return train(labelled_findings())


def scan(texts: list[str], forest: Forest) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, score) of each text's candidates."""
    found = [[(*c, features(t, *c)) for c in candidates(t)] for t in texts]
    rows = [c[3] for f in found for c in f]
    scores = iter(forest.predict(np.array(rows)).tolist() if rows else [])
    return [[(s, e, kind, next(scores)) for s, e, kind, _ in f] for f in found]


def find(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs(doc_id, text) -> one row a candidate: doc_id, start, length, kind, score, is_secret, value_sha256."""
    forest = forest or shipped()

    def findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = texts_of(batch.column("text")).to_pylist()
            rows = [
                (d, s, e - s, kind, score, score >= CUT, hashlib.sha256(t[s:e].encode()).hexdigest())
                for d, t, f in zip(batch.column("doc_id").to_pylist(), text, scan(text, forest), strict=True) for s, e, kind, score in f
            ]
            kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "kind": pa.string(), "score": pa.float64(), "is_secret": pa.bool_(), "value_sha256": pa.string()}
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(findings, "doc_id long, start long, length long, kind string, score double, is_secret boolean, value_sha256 string")


def redact(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """The same rows with secrets replaced by MASK."""
    forest = forest or shipped()

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            text = texts_of(column).to_pylist()
            out = []
            for t, f, null in zip(text, scan(text, forest), column.is_null().to_pylist(), strict=True):
                for s, e, _, score in reversed(f):
                    if score >= CUT:
                        t = t[:s] + MASK + t[e:]
                out.append(None if null else t)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = map_batches(docs, redacted)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
