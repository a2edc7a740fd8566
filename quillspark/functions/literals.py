"""What literal text a pattern can't do without, and one automaton that looks for the literals of many patterns at a time."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

#: Beginnings of a pattern at most, and their characters; more would make the automaton large without making it choosier.
MOST_BEGINNINGS, LONGEST = 800, 6


def _chars(items, most: int) -> list[str] | None:
    """The characters of a class, or None where these are many, or not listed."""
    out: list[str] = []
    for kind, value in items:
        if kind is C.LITERAL:
            out.append(chr(value))
        elif kind is C.RANGE and value[1] - value[0] < most:
            out += map(chr, range(value[0], value[1] + 1))
        else:
            return None
        if len(out) > most:
            return None
    return sorted(set(out))


def _then(so_far: dict[str, bool], more: dict[str, bool]) -> dict[str, bool] | None:
    """Beginnings followed by beginnings; None if that gives too many. A beginning that isn't open stays as it is, also where
    the same one is open on another way."""
    out: dict[str, bool] = {}
    for a, open_a in so_far.items():
        for b, open_b in more.items() if open_a else [("", False)]:
            s, is_open = (a + b)[:LONGEST], open_a and open_b and len(a + b) <= LONGEST
            out[s] = out.get(s, True) and is_open
        if len(out) > MOST_BEGINNINGS:
            return None
    return out


def _of_item(kind, value) -> dict[str, bool]:
    if kind is C.LITERAL:
        return {chr(value): True}
    if kind is C.IN:
        found = _chars(value, MOST_BEGINNINGS)
        return {"": False} if found is None else dict.fromkeys(found, True)
    if kind is C.SUBPATTERN:
        return {"": False} if value[1] & re.IGNORECASE else _of_sequence(value[-1])
    if kind is C.BRANCH:
        out: dict[str, bool] = {}
        for branch in value[1]:
            for s, is_open in _of_sequence(branch).items():
                out[s] = out.get(s, True) and is_open
        return out
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = value
        out = _of_sequence(list(body) * min(least, LONGEST + 1))
        if most == least:
            return out
        if (least, most) == (0, 1):
            return {**(once := _of_sequence(body)), "": once.get("", True)}
        return dict.fromkeys(out, False)
    if kind in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {"": True}
    return {"": False}


def _of_sequence(items) -> dict[str, bool]:
    """Beginnings of what a sequence matches: each match starts with one of them. The value tells whether what follows in the
    pattern comes right behind it."""
    out = {"": True}
    for kind, value in items:
        if not any(out.values()):
            break
        longer = _then(out, _of_item(kind, value))
        if longer is None:
            return dict.fromkeys(out, False)
        out = longer
    return out


def beginnings(regex: str) -> list[str]:
    """Strings of at most LONGEST characters, with one of which each match of the pattern starts; none if there are no such
    strings, as in patterns that ignore case or start with any digit of any script."""
    tree = _parser.parse(regex)
    if tree.state.flags & re.IGNORECASE:
        return []
    found = _of_sequence(tree)
    return [] if "" in found or len(found) > MOST_BEGINNINGS else sorted(found)


def needed(regex: str) -> str:
    """The longest run of literal characters that each match has somewhere; empty if there is none."""
    tree = _parser.parse(regex)
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs, run = [""], ""
    for kind, value in tree:
        if kind is C.LITERAL:
            run += chr(value)
        elif kind not in (C.AT, C.ASSERT, C.ASSERT_NOT):
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


class Scanner:
    """All matches of many patterns, as each pattern's own finditer() gives them, in one scan of a text.

    An Aho-Corasick automaton holds the beginnings of all patterns, and for patterns without any the literal that they need.
    A pattern is tried only where one of its beginnings stands, or, if it only has a needed literal, in texts that hold it;
    the few with neither are searched for in every text. Built at the first text, once in a worker.
    """

    def __init__(self, regexes: list[str]):
        self.regexes, self.automaton = regexes, None

    def __getstate__(self):
        return {"regexes": self.regexes, "automaton": None}

    def _build(self) -> None:
        import ahocorasick

        self.compiled = [re.compile(x) for x in self.regexes]
        # a match that starts at a word's edge with a word character can't follow a word character
        edged = [list(_parser.parse(x))[:1] == [(C.AT, C.AT_BOUNDARY)] for x in self.regexes]
        at: dict[str, list[int]] = {}
        inside: dict[str, list[int]] = {}
        self.everywhere = []
        for k, x in enumerate(self.regexes):
            found = beginnings(x)
            for s in found:
                at.setdefault(s, []).append(k)
            if not found:
                literal = needed(x)
                if literal:
                    inside.setdefault(literal, []).append(k)
                else:
                    self.everywhere.append(k)
        self.automaton = ahocorasick.Automaton()
        for s in {*at, *inside}:
            ks = at.get(s, [])
            at_edge = bool(ks) and all(edged[k] for k in ks) and (s[0].isalnum() or s[0] == "_")
            self.automaton.add_word(s, (len(s) - 1, ks, inside.get(s, []), at_edge))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, text: str):
        """(pattern number, start, end) of each match; those of a pattern by start."""
        if self.automaton is None:
            self._build()
        whole, tries = set(self.everywhere), set()
        if len(self.automaton):
            for end, (back, ks, inside, at_edge) in self.automaton.iter(text):
                whole.update(inside)
                if ks:
                    a = end - back
                    if at_edge and a and ((c := text[a - 1]).isalnum() or c == "_"):
                        continue
                    tries.update((a, k) for k in ks)
        behind: dict[int, int] = {}
        for a, k in sorted(tries):
            if a >= behind.get(k, 0) and (m := self.compiled[k].match(text, a)):
                behind[k] = m.end()
                yield k, a, m.end()
        for k in whole:
            for m in self.compiled[k].finditer(text):
                yield k, *m.span()
