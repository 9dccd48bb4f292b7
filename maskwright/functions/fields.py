"""Classification of form fields by their attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import FIELD_RULES, FieldRule, java

HINT_ATTRIBUTES = ("autocomplete", "name", "id", "aria_label", "placeholder", "data_testid", "class_name")


def hint(**attributes: Column) -> Column:
    """The attributes that say what a field holds, joined by spaces; empty ones are skipped."""
    return F.concat_ws(" ", *[F.nullif(attributes[a], F.lit("")) for a in HINT_ATTRIBUTES if a in attributes])


def _matches(rule: FieldRule, type_: Column, text: Column, opted: Column) -> Column:
    if rule.opt_out:
        return F.coalesce(opted, F.lit(False))
    found = F.lit(False)
    if rule.type:
        found = found | F.coalesce(F.lower(type_) == rule.type, F.lit(False))
    if rule.pattern:
        found = found | F.coalesce(text.rlike("(?i)" + java(rule.pattern)), F.lit(False))
    return found


def classify_field(type_: Column, text: Column, opted: Column) -> Column:
    """struct<rule_id, token, severity, label> of the first rule that matches, else
    null. ``opted``: whether the site marks the field as sensitive; which
    attributes count as such a mark is the caller's choice."""
    out = None
    for rule in FIELD_RULES:
        made = F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.token).alias("token"), F.lit(rule.severity).alias("severity"), F.lit(rule.label).alias("label"))
        out = F.when(_matches(rule, type_, text, opted), made) if out is None else out.when(_matches(rule, type_, text, opted), made)
    return out


def field_candidate(tag: Column, opted: Column, editable: Column) -> Column:
    """Whether an element is looked at as a field at all."""
    return F.lower(tag).isin("input", "textarea", "select") | F.coalesce(opted, F.lit(False)) | F.coalesce(editable, F.lit(False))
