"""Validation patterns (whole strings) to extraction patterns (inside texts). Runs on the driver over a catalog of some hundred patterns."""

from __future__ import annotations

import re

GROUP = re.compile(r"\(\?P?<[A-Za-z_]\w*>")


def unanchored(regex: str) -> str:
    """Without anchors, with plain groups for named ones: names may repeat, and the JVM knows fewer of them."""
    s = regex.strip().removeprefix("^")
    s = s[:-1] if s.endswith("$") and not s.endswith(r"\$") else s
    return GROUP.sub("(?:", s)


def _closing(s: str, start: int) -> int:
    """Where the group that opens at `start` ends; -1 if it doesn't. Escapes and character classes don't count."""
    depth, k, in_class = 0, start, False
    while k < len(s):
        c = s[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def demand_prefix(s: str) -> str:
    """An optional first group is made mandatory: a bare number in a text is no identifier."""
    end = _closing(s, 0) if s.startswith("(?:") else -1
    return s[: end + 1] + s[end + 2 :] if 0 < end < len(s) - 1 and s[end + 1] == "?" else s


def unwrapped(s: str) -> str:
    return s[3:-1] if s.startswith("(?:") and _closing(s, 0) == len(s) - 1 else s


def alternatives(s: str) -> list[str]:
    """Split at the bars outside of groups and classes."""
    out, start, k, in_class = [], 0, 0, False
    while k < len(s):
        c = s[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            k = max(k, _closing(s, k))
        elif c == "|":
            out.append(s[start:k])
            start = k + 1
        k += 1
    return [x.strip() for x in [*out, s[start:]] if x.strip()]


def compile_pattern(regex: str, noise_texts: list[str], noise_words: list[str]) -> tuple[str | None, int]:
    """(extraction pattern or None, alternatives dropped). An alternative goes if it doesn't compile, matches in a noise text
    or matches a noise word as a whole."""
    keep, gone = [], 0
    for a in alternatives(unwrapped(demand_prefix(unanchored(regex)))):
        try:
            inside, whole = re.compile(rf"\b{a}\b"), re.compile(a)
        except re.error:
            gone += 1
            continue
        if any(inside.search(t) for t in noise_texts) or any(whole.fullmatch(w) for w in noise_words):
            gone += 1
        else:
            keep.append(a)
    return (rf"\b{keep[0] if len(keep) == 1 else '(?:' + '|'.join(keep) + ')'}\b" if keep else None), gone


def clean_noise(words: list[str], legitimate: list[str]) -> list[str]:
    """Noise words that look like no legitimate identifier."""
    known = [re.compile(p) for p in legitimate]
    return [w for w in words if not any(p.fullmatch(w) for p in known)]


def assemble(entries: dict[str, dict], noise_texts: list[str], noise_words: list[str], moved: dict[str, tuple[str, str]] | None = None) -> dict[str, dict]:
    """{safe, excluded} of a catalog {db: {regex, category, uri?}}. moved: db -> (start of alternatives, new db) takes the
    alternatives that start so into a database of their own."""
    safe, excluded = {}, {}
    for db, e in sorted(entries.items()):
        pattern, gone = compile_pattern(e["regex"], noise_texts, noise_words)
        if pattern is None:
            excluded[db] = e | {"note": f"{gone} alternatives dropped"}
            continue
        parts = alternatives(unwrapped(pattern.removeprefix(r"\b").removesuffix(r"\b")))
        start, other = (moved or {}).get(db, (None, None))
        out = [p for p in parts if start and p.lstrip("(?:").startswith(start)]
        stay = [p for p in parts if p not in out]
        for name, some in ((db, stay), (other, out)):
            if some and name:
                safe[name] = e | {"pattern": rf"\b{some[0] if len(some) == 1 else '(?:' + '|'.join(some) + ')'}\b"}
    return {"safe": dict(sorted(safe.items())), "excluded": excluded}
