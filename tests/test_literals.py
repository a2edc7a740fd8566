"""The automaton behind extraction, held to each pattern's own finditer()."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions import literals, rules
from quillspark.operators import extract

CATALOG, HAND = [x[2] for x in rules.CATALOG_PATTERNS], [x[1] for x in rules.HAND_PATTERNS]
ODD = [r"\bab?c*d\b", r"\bxa|zb", r"(?i)gse\d+", r"x(?=y)|yx", r"(?:a|bc)(?:d|)e", r"[^a]b", r"a.c", r"\d+ab", r"(?<=z)a{2,3}", r"(?:aa)+b", r"[a-c]{2}[x-z]", r"(?P<q>ab)(?P=q)", r"b|", r"\Aab", r"ab$", "é[à-ü]"]


def plain(regexes, text):
    return sorted((k, *m.span()) for k, x in enumerate(regexes) for m in re.finditer(x, text))


def test_beginnings():
    assert literals.beginnings(r"\bGSE\d+\b") == ["GSE"] and literals.beginnings(r"\bHP[:_]\d{7}\b") == ["HP:", "HP_"]
    assert literals.beginnings(r"\bAT.G\d{5}") == ["AT"] and literals.beginnings(r"\bDO(?:ID)?[:_]\d+") == ["DO:", "DOID:", "DOID_", "DO_"]
    assert literals.beginnings(r"(?i)ab") == literals.beginnings(r"\d{3}_at") == literals.beginnings("a*b?") == []
    assert literals.needed(r"\b\d{3,}(?:_[a-z])?_at\b") == "_at" and literals.needed(r"\d+") == ""
    none = [x for x in CATALOG + HAND if not literals.beginnings(x)]
    assert none == [r"\b\d{3,}(?:_[a-z])?_at\b"]


@pytest.mark.parametrize("regexes", [CATALOG, HAND, CATALOG + HAND + ODD], ids=["catalog", "hand", "all"])
def test_all_matches_of_each_pattern(regexes):
    r = random.Random(11)
    scanner = literals.Scanner(regexes)
    seeds = "GSE12 GSM1 NM_000123.4 ENSG00000000001.2 ENSMUST00000000001 PRJNA7 SAMD123 CHEMBL25 rs123456 rs١٢٣٤٥ VCV000000001 GO:0000009 EC:1.1.1.1 EC 1.2.3.4 10.1234/ab.c 1abc P12345 P12345-2 A0A1B2C3D4 IPR000001 SRX007710 MGI:123456 R-HSA-1 R-HSA-1.2 PF00001 ORDO:XY PMC12 AT1G12345 1234_a_at 99_at LRG_1t1 tA(AGC)B URS0000000001_1 AAAAAAAAAAAAAA-BBBBBBBBBB-C ZDB-GENE-123456-1 hum0001.v1 insdc:AB123456".split()
    pieces = [*seeds, *"abcdexyzé_:.- \n(/", "ab", "abab", "GSE", "gse1", "aab", "yx", "GS", "E1"]
    found = 0
    for _ in range(600):
        text = "".join(r.choice(["", " ", "_", ", ", "x"]) + r.choice(pieces) for _ in range(r.randrange(0, 40)))
        want = plain(regexes, text)
        assert sorted(scanner.matches(text)) == want, text
        found += len(want)
    assert found > 500


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="abcdexyzAGSE0159_:. -é", max_size=60))
def test_any_text(text):
    assert sorted(SCANNER.matches(text)) == plain(CATALOG + HAND + ODD, text)


SCANNER = literals.Scanner(CATALOG + HAND + ODD)


def test_any_patterns():
    """Patterns put together at random, over texts of few letters."""
    r = random.Random(12)

    def pattern(depth=0):
        kind = r.randrange(9 if depth < 3 else 4)
        if kind < 3:
            return r.choice("abcd")
        if kind == 3:
            return r.choice(["[ab]", "[a-c]", r"\w", ".", "[^d]", r"\d"])
        if kind < 6:
            return pattern(depth + 1) + pattern(depth + 1)
        if kind == 6:
            return f"(?:{pattern(depth + 1)}|{pattern(depth + 1)})"
        return f"(?:{pattern(depth + 1)}){r.choice(['?', '*', '+', '{2}', '{1,3}', '{0,2}?'])}"

    for _ in range(300):
        regexes = [r.choice(["", r"\b"]) + pattern() + r.choice(["", r"\b"]) for _ in range(4)]
        regexes = [x for x in regexes if not re.fullmatch(x, "")]
        scanner = literals.Scanner(regexes)
        for _ in range(6):
            text = "".join(r.choices("abcd1 ", k=r.randrange(0, 25)))
            assert sorted(scanner.matches(text)) == plain(regexes, text), (regexes, text)


def test_no_patterns_and_no_text():
    assert list(literals.Scanner([]).matches("GSE1")) == [] == list(literals.Scanner(CATALOG).matches("")) == extract.Extractor([])("GSE1")
    assert extract.Extractor(extract.catalog_patterns())(None) == []
    import pickle

    again = pickle.loads(pickle.dumps(SCANNER))
    assert again.automaton is None and sorted(again.matches("GSE1 x")) == plain(CATALOG + HAND + ODD, "GSE1 x")
