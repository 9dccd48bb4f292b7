"""SQL names of the scalar functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .checksums import VERHOEFF_D, VERHOEFF_P
from .rules import TEXT_RULES, TextRule, java

# SQL bodies of temporary functions; they are inlined into the plans that call them.
_DIGITS = "filter(transform(split(reverse(d), ''), c -> try_cast(c AS INT)), c -> c IS NOT NULL)"
_LUHN = f"length(d) > 0 AND aggregate(transform({_DIGITS}, (c, i) -> CASE WHEN i % 2 = 0 THEN c WHEN c > 4 THEN 2 * c - 9 ELSE 2 * c END), 0, (a, c) -> a + c) % 10 = 0"


_TABLE = "array({})".format
_VERHOEFF = f"length(d) > 0 AND aggregate(transform({_DIGITS}, (c, i) -> {_TABLE(', '.join(map(str, VERHOEFF_P)))}[i % 8 * 10 + c]), 0, (a, c) -> {_TABLE(', '.join(map(str, VERHOEFF_D)))}[a * 10 + c]) = 0"
# A function can't call another one on a lambda's variable, so checks are written out.
_CHECKED = {k: f"transform(array(regexp_replace(m, '[^0-9]', '')), d -> {c})[0]" for k, c in (("card", f"length(d) BETWEEN 13 AND 19 AND {_LUHN}"), ("verhoeff", _VERHOEFF))}


def _rule(r: TextRule) -> str:
    pattern = java(r.pattern).replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all(t, '{pattern}', 0)"
    found = f"filter({found}, m -> {_CHECKED[r.check]})" if r.check else found
    return f"transform({found}, m -> named_struct('rule_id', '{r.id}', 'token', '{r.token}', 'severity', {r.severity}, 'text', m))"


def register(spark: SparkSession) -> None:
    """Make ``luhn(d)``, ``verhoeff(d)``, ``rule_hits(t)`` (a text's valid matches
    as rule_id, token, severity, text, in rule order) and the view
    ``text_rules`` known to SQL in this session."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION luhn(d STRING) RETURNS BOOLEAN RETURN {_LUHN}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION verhoeff(d STRING) RETURNS BOOLEAN RETURN {_VERHOEFF}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rule_hits(t STRING) RETURNS ARRAY<STRUCT<rule_id: STRING, token: STRING, severity: INT, text: STRING>> RETURN coalesce(concat({', '.join(map(_rule, TEXT_RULES))}), array())")
    rows = [(r.id, r.token, r.severity, r.label, r.pattern) for r in TEXT_RULES]
    spark.createDataFrame(rows, "rule_id string, token string, severity int, label string, pattern string").createOrReplaceTempView("text_rules")
