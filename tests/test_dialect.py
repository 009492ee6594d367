"""Python regexes restated for Java: the same matches, or refused when a policy is built."""

import re

import pytest
from pyspark.sql import functions as F

from maskwell.functions.catalog import custom_pattern
from maskwell.functions.dialect import from_python
from maskwell.operators.scrub import findings
from maskwell.plans.policy import Policy

REGEXES = [
    r"(?x) \d{3} # digits", "(?x)\n a b  # two\n [ ] c | \\# d \\  e", r"(?x: a b ) c", r"a(?#comment)b",
    r"(?i)straße|K\b", r"(?i:ab)C", r"a(?i:b(?-i:c))D", r"(?ai)\w+é", r"(?a:\w+)\w", r"(?a)\bé\b|\d+", r"(?u)\w+",
    r"(?s)a.b", r"a.b", r"(?s:a.)b.", r"(?m)^a.*$", r"^a", r"b$", r"\Aa|b\Z", r"(?m:^)b", r"a$\n?",
    r"[\d-]+", r"[^\W\d_]+", r"[\W]+x", r"[^\S\n]+", r"[]a]+", r"[^]a]+", r"[a&&b]+", r"[[a]+", r"[\]\\^-]+", r"[a-c\-x]+", r"[é-ü😀]+", r"[\x41-\x43\u00e9]",
    r"(a)(b)?\1", r"(?P<n>a|b)(?P=n)", r"(ab)\1?", r"(?i)(a)\1", r"((a)|(b))+\2", r"(.)\1", r"(x)\1(?:0)",
    r"a{2}", r"a{,2}b", r"a{1,}b", r"a+?b", r"a*+b", r"(?>a+)b", r"a{2,3}?", r"(?:ab){2,}", r"x?y??z", r"a{x", r"{", r"a{,}b",
    r"(?=ab)a", r"a(?!b)", r"(?<=a)b", r"(?<!a)b", r"(?<=\bx )y", r"(?!)|a", r"\b\w+\b", r"\Bb\B", r"(?a)\B\w",
    r"\t|\n|\x41|\101|\u00e9|\N{GREEK SMALL LETTER ALPHA}", r"\.\*\+\?\(\)\[\]\{\}\|\^\$\\/#&~@ -", r"a|b", r"ab|ac|ad", r"(|a)b", r"[ab]|c",
    r"\d+(?:\.\d+)?%?", r"EMP-\d{6}", r"(?:key|token)\s*[:=]\s*(\S+)", r"\s+\S", r"[\s,]+x", r"[^\s,]+",
]
TEXTS = [
    "", "abc", "123 4567 ab", "a b c # d  e", "STRASSE straße Straße K k K", "aBC abC ABC abcD aBcD", "é ab é9 é", "a\nb", "a\rb a\u2028b a\x85b", "ab\na\nb\n", "a\n", "b\n", "x\ny b",
    "-12-3- _x9é ++x", "]]a^\\-[a&&b]", "aab aa b aba baab xx0 x0", "aaab ab b aaaa", "a{x {", "xy x yz y z xyz", "😀é😀ü", "١٢٣ 12", "key = abc token:x", "a\tb \x1c c\xa0d", "EMP-123456 12.5%",
    "A\x41\u03b1 .*+?()[]{}|^$\\/#&~@ -", "cd ca ad , , x", "aa AA aA bb", "ab\r\nab", "_a_ a-b",
]


def test_the_same_matches(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    columns = [F.regexp_extract_all("t", F.lit(from_python(r)), F.lit(0)).alias(f"r{k}") for k, r in enumerate(REGEXES)]
    got = {row.i: row for row in df.select("i", *columns).collect()}
    bad = []
    for k, r in enumerate(REGEXES):
        for i, t in enumerate(TEXTS):
            want = [m.group() for m in re.finditer(r, t)]
            if got[i][f"r{k}"] != want:
                bad.append((r, t, want, got[i][f"r{k}"]))
    assert not bad, bad[:5]


def test_groups_keep_their_numbers(spark):
    regex = r"(?x) (?P<a> \w+ ) [=] (?P<b> ['\"]? ) (?P<v> \d+ ) (?P=b)  # name = value"
    df = spark.createDataFrame([("n='12' m=3 k=\"4\" z='5",)], "t string")
    java = from_python(regex)
    for g in (1, 2, 3):
        got = df.select(F.regexp_extract_all("t", F.lit(java), F.lit(g))).first()[0]
        assert got == [m.group(g) for m in re.finditer(regex, "n='12' m=3 k=\"4\" z='5")]


def test_verbose_pattern_in_a_policy(spark):
    own = custom_pattern("code", r"(?x) \b [A-Z]{2}  # two letters" + "\n" + r" - ( \d{3} ) \b", "pii")
    df = spark.createDataFrame([(1, "AB-123 and CD-456, a@b.co")], "id int, t string")
    found = findings(df, "id", "t", Policy(extra_patterns=(own,))).where("pattern = 'code'").orderBy("start").collect()
    assert [(r.original, r.start) for r in found] == [("AB-123", 0), ("CD-456", 11)]


def test_what_java_cannot_say_is_refused():
    for regex in (r"(a)?b(?(1)c|d)", r"(?P<q>')?x(?(q)')", "(a)" * 99 + r"\99"):
        with pytest.raises(ValueError, match="cannot be used"):
            custom_pattern("own", regex)
