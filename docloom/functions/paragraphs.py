"""When a paragraph goes on after a page: gates and points as SQL text, over the columns of a pair (a_, b_).

rx(column, pattern) writes the test of a regular expression in the dialect at hand; patterns hold no construct that RE2 lacks. The text may name the
columns far (1 or 2 pages), bridged (the page between holds nothing but visuals), headed (a heading stands before the target), and what layout(),
hyphen() and seam() give.
"""

from __future__ import annotations

from collections.abc import Callable

Rx = Callable[[str, str], str]


def layout() -> str:
    return "(a_y2 >= 0.72 and b_y1 <= 0.28)"


def hyphen(rx: Rx) -> str:
    return f"({rx('a_text', r'[[:alpha:]]-\s*$'.replace('[[:alpha:]]', r'[A-Za-z]'))} and {rx('b_text', r'^\s*[a-z]')})"


def seam(rx: Rx) -> str:
    """An open ending of the source or an open start of the target."""
    return f"({rx('a_text', r'(?:[,(-]|(?:^|\s)(?:and|or|of|the|to|in|with|for))\s*$')} or {rx('b_text', r'^\s*[a-zà-öø-ÿ]')})"


def _readable(rx: Rx, c: str) -> str:
    return rx(c, r"[A-Za-zÀ-ÿ].*[A-Za-zÀ-ÿ].*[A-Za-zÀ-ÿ].*[A-Za-zÀ-ÿ]")


def _title(rx: Rx, c: str) -> str:
    """At most 60 characters, all words but small ones with a capital, no end mark; or a caption's label."""
    return f"({rx(c, r'^\s*(?:Figure|Fig|Table|Chart)\.? [0-9]')} or (length({c}) <= 60 and {rx(c, r'^\s*(?:(?:[A-Z][A-Za-z-]*|of|and|the|in|for|to|a)\s*)+$')}))"


def gates(rx: Rx) -> str:
    """All that must hold, in the survey's order."""
    rules = (
        "(far = 1 or bridged)", f"{_readable(rx, 'a_text')} and {_readable(rx, 'b_text')}", f"not {rx('b_text', r'^\s*(?:[Pp]age|p\.)?\s*[0-9]{1,4}\s*$')}", f"not {rx('b_text', r'^\s*(?:https?://|www\.)[^ ]+\s*$')}",
        "(length(b_text) >= 8 or hyphen)", f"not {rx('b_text', r'^\s*(?:\([a-z]\)\s*[^ ]*\s*)+$')} and not {rx('a_text', r'^\s*(?:\([a-z]\)\s*[^ ]*\s*)+$')}",
        f"not (a_y1 >= 0.85 and {rx('a_text', r'^\s*(?:[*†‡]|[0-9]{1,2}\s)')})", f"not {rx('a_text', r'[.!?;:。！？；]\s*$')}", f"(hyphen or (not {_title(rx, 'a_text')} and not {_title(rx, 'b_text')}))",
        f"not {rx('a_text', r'^\s*(?:[☐☑✓□]|\[[ xX]\])')} and not {rx('b_text', r'^\s*(?:[☐☑✓□]|\[[ xX]\])')}", f"(seam or not (length(b_text) <= 60 and {rx('b_text', r'^\s*[A-Z].*[.!?]\s*$')}))",
        "(hyphen or (a_x2 - a_x1 >= 0.2 and b_x2 - b_x1 >= 0.2))", f"(layout or hyphen or {rx('b_text', r'^\s*[a-zà-öø-ÿ]')})", "(hyphen or not headed)", "(hyphen or length(a_text) >= 25)", "(layout or hyphen or seam)",
    )
    return " and ".join(f"({r})" for r in rules)


def score(overlap: str, rx: Rx) -> str:
    """Points of what holds; overlap is the shared width over the smaller one."""
    points = (
        ("far = 1", 0.05), ("layout", 0.25), ("a_section_id = b_section_id", 0.10), ("seam", 0.15), ("hyphen", 0.15), (f"not {rx('a_text', r'[.!?;:。！？；]\s*$')}", 0.20), (f"{overlap} >= 0.5", 0.05), ("far = 2 and bridged", 0.05),
    )
    return "0.10" + "".join(f" + case when {rule} then {p} else 0 end" for rule, p in points)
