"""Lexicons as one regular expression that shares beginnings.

A flat alternation of hundreds of terms is tried term by term at every character; here
terms with the same letters in front share them (to the depth of two letters), so most places fail
after one or two.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable


def _factored(terms: list[str], depth: int) -> str:
    if depth == 0 or len(terms) < 3:
        return "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    groups: dict[str, list[str]] = defaultdict(list)
    for t in terms:
        groups[t[:1]].append(t[1:])
    parts = []
    for head in sorted(groups, key=lambda h: (h == "", h)):
        tails = groups[head]
        if head == "":
            parts.append("")
        else:
            parts.append(re.escape(head) + ("(?:" + _factored(tails, depth - 1) + ")" if tails != [""] else ""))
    return "|".join(parts)


def lexicon_pattern(terms: Iterable[str], *, ignore_case: bool = True, depth: int = 2) -> str:
    """Pattern for any term that stands between characters other than ASCII letters and digits.

    An underscore separates; Java syntax (look-around).  No term at all matches nothing.
    """
    unique = sorted({t for t in terms if t})
    if not unique:
        return r"(?!)"
    flags = "(?iu)" if ignore_case else ""
    return f"{flags}(?<![0-9A-Za-z])(?:{_factored(unique, depth)})(?![0-9A-Za-z])"


def emoji_pattern() -> str:
    """Pictographs, symbols of the supplementary planes, dingbats, and the joiners behind them."""
    return "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B00}-\\x{2BFF}]"
