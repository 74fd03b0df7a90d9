"""Patterns of wording, as Spark's regular expressions are to read them.

Words end where ASCII letters, digits and ``_`` end: Java's own ``\\b`` counts other letters, too. Before a pattern is tried,
a text is searched for the literals of which every match holds one; a search costs far less than a pattern at every place.
Where hundreds of literals are looked for, one pattern that branches letter by letter finds in one pass whether any is there.
"""

from __future__ import annotations

import re

from timberline.functions.sqltext import Sql

BOUND, NO_BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def ascii_words(pattern: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"b": BOUND, "B": NO_BOUND}.get(m[1], m[0]), pattern, flags=re.DOTALL)


def needed(pattern: str) -> frozenset[str] | None:
    """Texts of which each match holds one at least; None if none is known, as for patterns that only Java reads."""
    try:
        return _needed(re._parser.parse(pattern))
    except re.error:
        return None


def _needed(parts) -> frozenset[str] | None:
    found, run = [], ""
    for op, value in [*parts, (None, None)]:
        if op is re._constants.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if op is re._constants.SUBPATTERN:
            inner = _needed(value[3])
        elif op is re._constants.BRANCH:
            ways = [_needed(w) for w in value[1]]
            inner = frozenset().union(*ways) if all(ways) else None
        elif op in (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT) and value[0]:
            inner = _needed(value[2])
        if inner:
            found.append(inner)
    # The longer the shortest of them, the rarer; of equals the fewer.
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def any_needed(patterns: list[str]) -> str | None:
    """A pattern that finds, in lower case, some literal of each text that one of the patterns meets; None if there is none."""
    each = [needed(p) for p in patterns]
    if not all(each):
        return None
    tree: dict = {}
    for one in sorted({x.lower() for x in frozenset().union(*each)}, key=len):
        node = tree
        for c in one:
            if None in node:  # a shorter literal is found first
                break
            node = node.setdefault(c, {})
        else:
            node[None] = None
    return _branches(tree)


#: Letters that one look ahead tells apart from the rest: fewer tries at each place of a text.
AT_ONCE = 6


def _branches(tree: dict) -> str:
    if None in tree:
        return ""
    ways = [re.escape(c) + _branches(tree[c]) for c in sorted(tree)]
    if len(ways) > 2 * AT_ONCE:
        letters = [re.escape(c) for c in sorted(tree)]
        ways = [f"(?=[{''.join(letters[k:k + AT_ONCE])}])(?:{'|'.join(ways[k:k + AT_ONCE])})" for k in range(0, len(ways), AT_ONCE)]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


def meets(text: Sql, low: Sql, pattern: str, any_case: bool = False) -> Sql:
    """Whether a text meets the pattern; ``low`` is the text in lower case."""
    hit = text.rlike(("(?i)" if any_case else "") + ascii_words(pattern))
    some = None
    for one in sorted({x.lower() for x in needed(pattern) or ()}):
        some = low.contains(one) if some is None else some | low.contains(one)
    return hit if some is None else some & hit
