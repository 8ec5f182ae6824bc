"""Text functions as Column expressions: normalisation, tokens, ids and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII words with inner joints, single CJK characters, other letters. The first part is ASCII only.
TOKEN = r"[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]|\p{L}+"
CJK = r"^[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]$"


#: Letters whose folding holds ASCII letters or several characters: folded before tokens are cut, they would move a token's ends.
_FOLDS_WIDE = "[ßẞİKſŉǰΐΰևẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆﬓﬔﬕﬖﬗ]"


def casefold(c: Column) -> Column:
    """Lower case with sharp s as ss, long s as s, final sigma as sigma, and ligatures as their letters."""
    c = F.lower(c)
    for wide, plain in (("ß", "ss"), ("ſ", "s"), ("ς", "σ"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(wide), F.lit(plain))
    return c


_ASCII = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\s": r"[\t\n\f\r ]", r"\S": r"[^\t\n\f\r ]"}


def by_ascii(pattern: str) -> str:
    """The pattern with what \\b, \\s and the ends of lines mean in SQL's engine, which knows ASCII words and spaces and \\n alone; Java's \\b takes other letters into words, too."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        inside = (inside or pair == "[") and pair != "]"
        out.append(r"\t\n\f\r " if inside and pair == r"\s" else _ASCII.get(pair, pair))
        i += len(pair)
    return "(?d)" + "".join(out)


def base_tokens(c: Column) -> Column:
    """Folded tokens. A text without letters that fold wide is folded as a whole, which no token's ends depend on; else each token by itself."""
    cut = lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    return F.when(F.rlike(c, F.lit(_FOLDS_WIDE)), F.transform(cut(c), casefold)).otherwise(cut(F.replace(F.lower(c), F.lit("ς"), F.lit("σ"))))


def search_terms(c: Column) -> Column:
    """Tokens and, for CJK characters that stand together, their pairs."""
    pairs = F.transform(F.regexp_extract_all(c, F.lit(r"(?=([\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]{2}))"), F.lit(1)), casefold)
    return F.concat(base_tokens(c), pairs)


def normalize_text(c: Column) -> Column:
    """LF line ends, single spaces, none around tabs, no blank lines."""
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[  ]+", " ")
    lines = F.transform(F.split(F.regexp_replace(c, r" ?\t ?", "\t"), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def plain_text(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def html_to_text(c: Column) -> Column:
    """A tab for each cell, a line for each row, paragraph, item and break; the common references decoded."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", "")
    c = F.regexp_replace(c, r"(?i)</t[dh]\s*>", "\t")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(tr|p|li|div|h[1-6])\s*>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return normalize_text(F.regexp_replace(c, r"\t+(?=\n|$)", ""))


def drop_adjacent_repeats(values: Column) -> Column:
    """Array without elements that repeat the one before them, by folded text."""
    key = lambda x: casefold(F.trim(x))
    return F.filter(values, lambda x, i: (i == 0) | (key(x) != key(F.get(values, i - 1))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def digest(*parts: Column, size: int = 12) -> Column:
    """Prefix of the sha256 of the parts as a compact JSON array of strings."""
    return F.substring(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), 1, size)


def clean_answer(c: Column) -> Column:
    """Trimmed, folded, single spaces, no trailing points or spaces."""
    return F.regexp_replace(F.regexp_replace(casefold(F.trim(c)), r"\s+", " "), r"[. ]+$", "")


def is_not_answerable(c: Column) -> Column:
    return clean_answer(c).isin("not answerable", "unanswerable", "none", "n/a", "")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}", ""))


def readable_prose(c: Column) -> Column:
    visible = F.length(F.regexp_replace(c, r"\s", ""))
    return (letters(c) >= 4) & (F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) >= 0.35 * visible)


def title_fragment(c: Column) -> Column:
    """At most 12 words and 100 characters, at least four in five of the words with a capital."""
    words = F.regexp_extract_all(c, F.lit(r"\p{L}[\p{L}'-]*"), F.lit(0))
    capital = F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{Lu}"))))
    return (F.size(words) > 0) & (F.size(words) <= 12) & (F.length(c) <= 100) & (capital >= 0.8 * F.size(words))


def open_ended(c: Column) -> Column:
    """No final punctuation: the sentence may go on."""
    return ~F.rlike(c, F.lit(r"[.!?。！？;；:]\s*$"))


def lower_start(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\s*\p{Ll}"))


def standalone_url(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\s*(?:https?://|www\.)\S+\s*$"))


def page_marker(c: Column) -> Column:
    return F.rlike(c, F.lit(r"(?i)^\s*(?:page|p\.)?\s*[0-9]{1,4}(?:\s*(?:of|/)\s*[0-9]{1,4})?\s*$"))


def subfigure_line(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\s*(?:\([a-z]\)\s*\S*\s*)+$"))


#: Label patterns by kind; the number is group 1.
LABELS = {
    "figure": r"(?i)\b(?:figure|fig\.?)\s*([0-9]+(?:\.[0-9]+)*[a-z]?|[IVX]+)\b",
    "table": r"(?i)\b(?:table|tab\.)\s*([0-9]+(?:\.[0-9]+)*[a-z]?|[IVX]+)\b",
    "section": r"(?i)\b(?:section|sec\.)\s*([0-9]+(?:\.[0-9]+)*)\b",
    "listing": r"(?i)\b(?:listing|algorithm)\s*([0-9]+(?:\.[0-9]+)*)\b",
}


def label_numbers(kind: str, c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(LABELS[kind]), F.lit(1)), lambda x: F.lower(x))


# Fixed patterns of the numbers that labels have: the number, and a part of it in brackets or behind it. The first one that matches counts.
_PART = r"[A-Za-z](?:\s*[-\x{2012}\x{2013}\x{2014}]\s*[A-Za-z])?"
_PARTS = rf"(?:\s*(?:\(\s*({_PART})\s*\)|({_PART})))?(?![A-Za-z0-9_])"
LABEL_NUMBERS = {
    "figure": (rf"(?i)(?:Figure|Fig\.?)\s*([0-9]+|(?-i:[IVXLCDM]+)){_PARTS}", rf"(?i)图\s*([0-9]+){_PARTS}"),
    "table": (rf"(?i)Table\s*([0-9]+|(?-i:[IVXLCDM]+)){_PARTS}", rf"(?i)表\s*([0-9]+){_PARTS}"),
    "section": (r"^\s*([0-9]+(?:\.[0-9]+)*)(?=$|[^\d.]|\.(?!\d))", r"(?i)^\s*([IVXLCDM]+)(?=$|\s|[:.\-])", r"第\s*([0-9]+(?:\.[0-9]+)*)\s*节"),
    "listing": (r"(?i)Listing\s*([0-9]+)(?![A-Za-z0-9_])",),
}


#: The same in Arabic numbers with at most a letter behind, as the SQL of queries has them; sections stand before a space.
ARABIC_NUMBERS = {
    **{k: (rf"(?i)(?:{names})[\t\n\f\r ]*([0-9]+)(?:[\t\n\f\r ]*([A-Za-z]))?()(?:[^A-Za-z0-9_]|$)",) for k, names in (("figure", r"Figure|Fig[^\n]?"), ("table", "Table"))},
    "section": ("^([0-9]+) ",),
}


def label_number(kind: str, c: Column, patterns: dict[str, tuple[str, ...]] = LABEL_NUMBERS) -> Column:
    """The number of the first label of a kind in the text, with its part: "2", "iv", "3a", "3a-c"; null without one."""
    found = []
    for pattern in patterns[kind]:
        base = F.lower(F.regexp_extract(c, pattern, 1))
        part = F.concat(F.regexp_extract(c, pattern, 2), F.regexp_extract(c, pattern, 3)) if kind in ("figure", "table") else F.lit("")
        part = F.lower(F.regexp_replace(F.regexp_replace(part, r"\s+", ""), r"[\x{2012}\x{2013}\x{2014}]", "-"))
        found.append(F.when(base != "", F.concat(base, part)))
    return F.coalesce(*found)


def recall_terms(c: Column, stop: tuple[str, ...] = ("the", "a", "an", "of", "in", "and", "or", "to", "is", "are", "was", "were", "what", "which", "how", "many", "for", "on", "by", "with")) -> Column:
    """Distinct folded alphanumerics, decimals and percentages whole, without stop words."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)*%?|[\p{L}\p{N}]+"), F.lit(0)), casefold)
    return F.array_except(F.array_distinct(found), F.array(*(F.lit(s) for s in stop)))


#: Question features by pattern.
QUESTION_FEATURES = {
    "visual": r"(?i)\b(figure|chart|image|picture|color|colour|diagram|graph|map|logo)\b",
    "table": r"(?i)\b(table|row|column|cell)\b",
    "multi_page": r"(?i)\b(pages|across|throughout|whole document|all sections)\b",
    "coverage": r"(?i)\b(how many|list all|count|every|all the)\b",
    "comparison": r"(?i)\b(more|less|higher|lower|greater|compared?|difference|largest|smallest|than)\b",
    "derived": r"(?i)\b(sum|total|average|ratio|percentage|increase|decrease)\b",
}


def question_features(c: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.rlike(c, F.lit(p)), F.lit(k)) for k, p in QUESTION_FEATURES.items())))


def short_independent(c: Column) -> Column:
    """A short sentence of its own: a capital first, an end mark last."""
    return (F.length(c) < 60) & F.rlike(c, F.lit(r"^\s*[A-Z].*[.!?]\s*$"))


def checklist_item(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\s*(?:[☐☑✓□]|\[[ xX]\])"))


def external_reference(c: Column) -> Column:
    """A section of a law rather than of the document: a legal word shortly before it."""
    return F.rlike(c, F.lit(r"(?i)\b(?:act|code|statute|regulation|u\.s\.c|cfr)\b[^.]{0,60}\bsection\s+[0-9]"))


def low_information(c: Column) -> Column:
    return F.rlike(F.trim(c), F.lit(r"(?i)^(?:yes|no|n/a|[-–—•.]+|[0-9]{1,3})$"))


def meaningful(c: Column) -> Column:
    return F.rlike(c, F.lit(r"[A-Za-zÀ-ÿ]{2,}|[0-9]{2,}"))


def compact_heading(text: str) -> str:
    """Letters and digits of the compatibility form, ASCII only, lower case."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFKD", text or "").lower() if c.isascii() and c.isalnum())


def heading_match(a: str, b: str) -> float:
    """1 for headings that are equal when compacted, .98 where one of six characters or more begins the other, else the likeness of their characters."""
    from difflib import SequenceMatcher

    x, y = sorted((compact_heading(a), compact_heading(b)), key=len)
    if not x:
        return 0.0
    return 1.0 if x == y else 0.98 if len(x) >= 6 and y.startswith(x) else SequenceMatcher(None, x, y, autojunk=False).ratio()
