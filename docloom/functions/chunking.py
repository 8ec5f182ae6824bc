"""Chunks, token offsets, HTML tables, anchors and text comparison: plain Python cores under Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# A text of more tokens than the first is cut into windows of the second that share the third; a window may end early at a line break, but not before this part of it.
WHOLE, WINDOW, SHARED, EARLIEST = 256, 256, 32, 0.65
# Texts whose parts a task holds together.
TOGETHER = 200
# Tokens are ASCII words with inner joints, single CJK characters, and runs of other letters.
_TOKEN = re.compile(r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[㐀-䶿一-鿿]|[^\W\d_]+")


def token_spans(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group().casefold()) for m in _TOKEN.finditer(text)]


def is_cjk(token: str) -> bool:
    return len(token) == 1 and ("\u3400" <= token <= "\u4dbf" or "\u4e00" <= token <= "\u9fff")


def search_spans(text: str) -> list[tuple[int, int, str]]:
    """Tokens, and as terms of their own the pairs of CJK characters that touch, by place."""
    spans = token_spans(text)
    if len(spans) < 2:
        return spans
    begin, end = (np.array([s[k] for s in spans]) for k in (0, 1))
    cjk = np.array([is_cjk(s[2]) for s in spans])
    first = np.flatnonzero(cjk[:-1] & cjk[1:] & (end[:-1] == begin[1:]))
    return sorted(spans + [(spans[k][0], spans[k + 1][1], spans[k][2] + spans[k + 1][2]) for k in first])


def windows(n: int, stops: list[int], size: int, shared: int, earliest: float) -> list[tuple[int, int]]:
    """Windows [begin, end) over n tokens. stops are the sorted places between tokens at which a window had rather end: it takes the last one in its late part."""
    out: list[tuple[int, int]] = []
    begin = 0
    while not out or out[-1][1] < n:
        end = min(n, begin + size)
        if end < n:
            k = bisect_right(stops, end) - 1
            if k >= 0 and stops[k] >= begin + max(1, int(earliest * (end - begin))):
                end = stops[k]
        out.append((begin, end))
        begin = max(begin + 1, end - shared)
    return out


def chunk_ranges(text: str, whole: int = WHOLE, size: int = WINDOW, shared: int = SHARED) -> list[tuple[int, int]]:
    """Character ranges of the parts of a text, without white space at their ends; a blank text has none."""
    spans = token_spans(text)
    begins = [0] + [s[0] for s in spans[1:]] + [len(text)]
    if len(spans) <= whole:
        cuts = [(0, len(text))] if text.strip() else []
    else:
        lines = [k for k, c in enumerate(text) if c == "\n"]
        stops = [k for k in range(1, len(spans)) if bisect_left(lines, begins[k]) > bisect_left(lines, spans[k - 1][1])]
        cuts = [(begins[a], begins[b]) for a, b in windows(len(spans), stops, size, shared, EARLIEST)]
    out = []
    for a, b in cuts:
        part = text[a:b]
        out.append((a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
    return out


def segment_ranges(text: str, count: Callable[[str], list[tuple[int, int]]], budget: int = 480, overlap: int = 48, hard: int = 512) -> list[tuple[int, int]]:
    """Windows of at most `budget` model tokens that overlap and leave no character out; one of more than `hard` tokens by its own count is an error."""
    spans = count(text)
    if len(spans) <= budget:
        out = [(0, len(text))]
    else:
        cuts = windows(len(spans), [], budget, overlap, 1.0)
        out = [(0 if a == 0 else spans[a][0], len(text) if b == len(spans) else spans[b - 1][1]) for a, b in cuts]
    reached = 0
    for a, b in out:
        if text[reached:a].strip() or len(count(text[a:b])) > hard:
            raise ValueError("segments leave something out or are too long")
        reached = max(reached, b)
    if text[reached:].strip():
        raise ValueError("segments leave something out")
    return out


def explode_texts(rows: DataFrame, keys: list[str], text: str, each: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """One row for each tuple that `each` finds in a text, in Arrow batches; nulls have none."""
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", part int, " + columns
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), TOGETHER):
                own = frame.iloc[at : at + TOGETHER]
                out = [(*key, part, *found) for *key, t in zip(*(own[k] for k in keys), own[text], strict=True) if t is not None for part, found in enumerate(each(t))]
                yield pd.DataFrame(out, columns=[*keys, "part", *names])

    return rows.select(*keys, text).mapInPandas(run, schema)


def chunks(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Search units: part number, range, text and token count of each part."""
    each = lambda t: [(s, e, t[s:e], len(token_spans(t[s:e]))) for s, e in chunk_ranges(t)]
    return explode_texts(rows, keys, text, each, "start int, stop int, content string, tokens int")


class _Cells(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.cell: list | None = None
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.depth += 1
        if self.depth > 1:
            return
        if tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            given = dict(attrs)
            span = lambda k: max(1, min(1000, int(v))) if (v := (given.get(k) or "1").strip()).isdigit() else 1
            self.cell = [tag == "th", span("rowspan"), span("colspan"), ""]
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell:
            self.cell[3] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag == "table":
            self.depth -= 1
        elif tag in ("td", "th") and self.depth == 1:
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None and self.depth <= 1:
            self.cell[3] += data


def table_cells(html: str) -> list[tuple[int, int, int, int, bool, str]]:
    """(row, column, rowspan, colspan, header, text) of the cells of a table, placed where no earlier span reaches."""
    parser = _Cells()
    parser.feed(html)
    parser.close()
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(parser.rows):
        c = 0
        for header, down, across, text in row:
            while (r, c) in taken:
                c += 1
            down = min(down, len(parser.rows) - r)
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
            out.append((r, c, down, across, header, " ".join(text.split())))
            c += across
    return out


def header_rows(cells: list[tuple[int, int, int, int, bool, str]]) -> int:
    """How many rows from the top hold header cells only."""
    n = 0
    while (own := [c for c in cells if c[0] == n]) and all(c[4] for c in own):
        n += 1
    return n


def row_lines(cells: list[tuple[int, int, int, int, bool, str]]) -> list[str]:
    return [f"r{r}c{c}: {text}" for r, c, _, _, _, text in cells]


def row_relevance(terms: set[str], cells: list[str]) -> float:
    """For each query term its best match in a row: 3 equal, 2 contained (4 letters on), 1.5 times a likeness of .82 on (5 on)."""
    words = {w for c in cells for _, _, w in token_spans(c)}
    total = 0.0
    for t in terms:
        if t in words:
            total += 3
        elif len(t) >= 4 and any(t in w or (len(w) >= 4 and w in t) for w in words):
            total += 2
        elif len(t) >= 5:
            best = max((SequenceMatcher(None, t, w).ratio() for w in words if len(w) >= 5), default=0)
            total += 1.5 * best if best >= 0.82 else 0
    return total


# The words that name a place in a document, and how each kind writes its label.
ANCHOR_WORDS = {"page": "page", "p.": "page", "slide": "slide", "figure": "figure", "fig.": "figure", "fig": "figure", "table": "table", "section": "section", "图": "figure", "表": "table", "第": "ordinal"}
ORDINAL_UNITS = {"页": "page", "节": "section"}
_KEYWORD = re.compile("|".join(re.escape(w) for w in sorted(ANCHOR_WORDS, key=len, reverse=True)), re.IGNORECASE)
_EXAMPLE = re.compile(r"(?i)(?:\be\.g\.|\bfor example\b|\bfor instance\b|\bin the (?:form|format) (?:of|like)\b)[^.;)\n]*(?:\.(?=\d)[^.;)\n]*)*")
_ROMAN = frozenset("IVXLCDM")


class _Scanner:
    """Reads labels at a place of a text: numbers with sub-labels, numerals, numbers in parts, numbers in parentheses."""

    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def peek(self, far: int = 0) -> str:
        return self.text[self.at + far : self.at + far + 1]

    def spaces(self) -> None:
        while self.peek().isspace():
            self.at += 1

    def take(self, of: Callable[[str], bool]) -> str:
        begin = self.at
        while self.peek() and of(self.peek()):
            self.at += 1
        return self.text[begin : self.at]

    def digits(self) -> str:
        return self.take(lambda c: c in "0123456789")

    def letter(self) -> str:
        """A sub-label: a letter, bare or in parentheses; nothing is taken where there is none."""
        begin = self.at
        self.spaces()
        if self.peek() == "(":
            self.at += 1
            self.spaces()
            found = self.peek() if self.peek().isascii() and self.peek().isalpha() else ""
            self.at += 1
            self.spaces()
            if found and self.peek() == ")":
                self.at += 1
                return found
        self.at = begin
        if self.peek().isascii() and self.peek().isalpha():
            self.at += 1
            return self.text[self.at - 1]
        return ""

    def ends(self) -> bool:
        """Whether a label may end here: no letter, digit or underscore follows, nor a further part of a number."""
        c = self.peek()
        return not (c == "_" or (c.isascii() and c.isalnum()) or (c == "." and self.peek(1).isdigit()))

    def label(self, kind: str) -> str:
        """The label of a kind, lower case, or nothing."""
        self.spaces()
        if kind == "section":
            parts = [self.digits()]
            while parts[-1] and self.peek() == "." and self.peek(1).isdigit():
                self.at += 1
                parts.append(self.digits())
            return ".".join(parts) if parts[0] and not (self.peek().isascii() and self.peek().isdigit()) else ""
        if kind in ("page", "slide"):
            held = self.peek() == "("
            self.at += held
            self.spaces()
            found = self.digits()
            end = self.at
            self.spaces()
            self.at = self.at + 1 if held and self.peek() == ")" else end
            return found if found and not (self.peek() == "." and self.peek(1).isdigit()) else ""
        found = self.digits()
        if not found:
            found = self.take(lambda c: c in _ROMAN)
            if not found:
                return ""
            end, sub = self.at, self.letter()
            if sub and self.text[end : self.at].strip()[:1] != "(":
                return ""
        else:
            sub = self.letter()
        return (found + sub).lower() if self.ends() else ""


def anchor_mentions(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, label, start, end) of the places that a text names, each once, in order; what stands in an example of an answer's form is none."""
    examples = [m.span() for m in _EXAMPLE.finditer(text)]
    found: list[tuple[str, str, int, int]] = []
    for m in _KEYWORD.finditer(text):
        word, kind = m.group(), ANCHOR_WORDS[m.group().lower()]
        before = text[m.start() - 1 : m.start()]
        if word.isascii() and (before == "_" or before.isalnum()):
            continue
        scan = _Scanner(text, m.end())
        if kind == "ordinal":
            label = scan.label("section")
            scan.spaces()
            kind = ORDINAL_UNITS.get(scan.peek(), "") if label else ""
            scan.at += 1
            if kind == "page" and "." in label:
                kind = ""
        else:
            label = scan.label(kind)
        if label and kind and not any(a <= m.start() < b for a, b in examples):
            found.append((kind, label, m.start(), scan.at))
    # of mentions that overlap the longer stands
    free, kept = 0, []
    for f in sorted(found, key=lambda f: (f[2], -f[3])):
        if f[2] >= free or not kept:
            kept.append(f)
        elif f[3] - f[2] > kept[-1][3] - kept[-1][2]:
            kept[-1] = f
        free = kept[-1][3]
    first: dict[tuple[str, str], tuple[str, str, int, int]] = {}
    for f in kept:
        first.setdefault(f[:2], f)
    return list(first.values())


def expand_labels(value: str, most: int = 32) -> list[str]:
    """'1-4', '1, 3 and 5': the labels meant; a range of more than `most` is left out."""
    out: list[str] = []
    for part in re.split(r"\s*(?:,|;|\band\b|&|和|及)\s*", value.strip()):
        if m := re.fullmatch(r"([0-9]+)\s*(?:-|–|—|to|至)\s*([0-9]+)", part):
            a, b = int(m[1]), int(m[2])
            if a <= b < a + most:
                out += [str(k) for k in range(a, b + 1)]
        elif part:
            out.append(part)
    return list(dict.fromkeys(out))


def similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def uncovered(line: str, texts: list[str], least: int = 4) -> list[str]:
    """What of a line none of the texts holds, by longest common stretches."""
    parts = [line]
    for t in texts:
        rest = []
        for p in parts:
            while p:
                m = SequenceMatcher(None, p, t, autojunk=False).find_longest_match()
                if m.size < least:
                    rest.append(p)
                    break
                rest.append(p[: m.a])
                p = p[m.a + m.size :]
        parts = [p for p in rest if len(p.strip()) >= least]
    return [p.strip() for p in parts]


# Headings of the highest level by name, and by their first word; what a numbered kind's level starts from.
KNOWN_TOP = frozenset("abstract introduction background conclusion conclusions references bibliography acknowledgements acknowledgments contents index summary discussion results methods".split())
LEVEL_WORDS = {"appendix": 1, "part": 1, "chapter": 1, "item": 1}
_NUMERAL = re.compile(r"(?i)[ivxlcdm]+|\d+")


def _number(token: str) -> list[str] | None:
    """The parts of '2.3.1', 'B.2' or 'A.': each a number, the first may be a capital; else nothing."""
    parts = token.removesuffix(".").split(".")
    first = parts[0].isdecimal() or (len(parts[0]) == 1 and parts[0].isascii() and parts[0].isupper())
    return parts if first and all(p.isdecimal() for p in parts[1:]) else None


def explicit_level(text: str, has_part: bool = False, most: int = 6) -> int | None:
    """The level that a heading's own words say: by the parts of its number, by its first word, or by name."""
    tokens = text.split()
    if not tokens:
        return None
    word, rest = tokens[0].lower().rstrip(".:"), tokens[1:]
    if word in LEVEL_WORDS and rest:
        label = rest[0].rstrip(".:,")
        if word == "appendix":
            parts = _number(label.upper()) if len(label.split(".")[0]) == 1 else None
            return min(most, LEVEL_WORDS[word] + len(parts) - 1) if parts else None
        if word == "item":
            return LEVEL_WORDS[word] + has_part if re.fullmatch(r"\d+[A-Za-z]?", label) else None
        return LEVEL_WORDS[word] if _NUMERAL.fullmatch(label) else None
    if " ".join(tokens).lower().rstrip(":") in KNOWN_TOP:
        return 1
    parts = _number(tokens[0])
    if not parts or not rest:
        return None
    if parts[0].isdecimal() or len(parts) > 1:
        return min(most, len(parts))
    # a capital alone numbers an appendix where a title follows it: 'A Proofs', 'B. More'
    return 1 if len(tokens) <= 8 and rest[0][:1].isupper() and (tokens[0].endswith(".") or tokens[0] != "I") else None


def heading_levels(headings: DataFrame, most: int = 6) -> DataFrame:
    """headings(doc, pos, text, style) -> level and how it was found, one document at a time, for a level may follow from those before.

    Numbered headings say their level; a style takes the level that numbered headings of it share; else the level before, at most 3.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos", kind="stable")
        has_part = any(t.split()[:1] and t.split()[0].lower() == "part" and explicit_level(t) == 1 for t in frame["text"])
        said = [explicit_level(t, has_part, most) for t in frame["text"]]
        styles: dict[str, set[int]] = {}
        for s, level in zip(frame["style"], said, strict=True):
            if level is not None:
                styles.setdefault(s, set()).add(level)
        out, before = [], None
        for s, level in zip(frame["style"], said, strict=True):
            if level is not None:
                out.append((level, "numbering", 1.0))
            elif len(styles.get(s, ())) == 1:
                out.append((min(3, next(iter(styles[s]))), "style", 0.86))
            elif before is not None:
                out.append((min(3, before), "previous", 0.58))
            else:
                out.append((1, "top", 0.55))
            before = out[-1][0]
        return pd.DataFrame({"doc": frame["doc"], "pos": frame["pos"], "level": [o[0] for o in out], "method": [o[1] for o in out], "confidence": [o[2] for o in out]})

    return headings.groupBy("doc").applyInPandas(one, "doc string, pos long, level int, method string, confidence double")


def first_best_cells(rows: DataFrame, keys: list[str], html: str) -> DataFrame:
    """The cells of HTML tables as rows."""
    return explode_texts(rows, keys, html, table_cells, "r int, c int, rowspan int, colspan int, header boolean, text string").drop("part")


