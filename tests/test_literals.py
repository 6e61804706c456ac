"""Literals that patterns need: never missing from a match, and findings as without them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import catalog as C
from sparkwarden.operators.literals import may_match, required


@pytest.mark.parametrize("pattern,literals", [
    ("abc", {"abc"}), ("a+bcd?", {"bc"}), ("(?:foo|bar)baz", {"baz"}), ("x(?:foo|ba)y?", {"foo", "ba"}), ("(?:foo|b*)", None), ("[ab]cd", {"cd"}), ("a*", None), ("(abcd){0,2}ef", {"ef"}), ("(abcd){1,2}ef", {"abcd"}),
    ("(?i)AbC", {"abc"}), ("(?=foo)\\w+", None), ("a.b", {"a"}), ("fée", None), ("(unclosed", None), ("^\\s*import\\s", {"import"}), ("(?:eval|evaluate)\\(", {"eval"}), ("[xy]", {"x", "y"}), ("\\d", None),
])
def test_needed(pattern, literals):
    need = required(pattern)
    got = None if need is None else set(need[0])
    if pattern == "(?:eval|evaluate)\\(":
        assert got in ({"eval"}, {"("})
    elif pattern == "a.b":
        assert got in ({"a"}, {"b"})
    else:
        assert got == literals


def test_every_rule_finds_as_much_as_without(spark):
    rules = [r for n in ("JS_RULES", "TS_RULES", "GO_RULES", "DOCKER_RULES", "K8S_RULES", "TF_LINE_RULES", "TF_BLOCK_RULES") for r in getattr(C, n)]
    patterns = sorted({p for r in rules for p in r.patterns})
    r = random.Random(2)
    words = sorted({w for p in patterns for w in re.findall(r"[A-Za-z_./]+", p)}) + ["ſ", "K", "İ", "(", ")", "{", "=", '"', "+", ":", "x", " ", "password", "token"]
    lines = ["".join(r.choice(words) + r.choice(["", " ", "(", " = ", ": "]) for _ in range(r.randint(0, 8))) for _ in range(400)]
    lines += [x.upper() for x in lines[:100]] + ["paſſword = \"abcdefghijk\"", "toKen := \"abcdefghijk\"", "", None]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    tests = [(p, may_match(F.col("t"), (p,))) for p in patterns]
    lost = [F.count_if(F.col("t").rlike("(?dU)" + p) & ~need).alias(f"c{i}") for i, (p, need) in enumerate(tests) if need is not None]
    assert len(lost) > 30 and set(df.agg(*lost).first()) == {0}
