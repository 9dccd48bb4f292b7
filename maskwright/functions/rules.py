"""Detection rules as plain data."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class TextRule:
    id: str
    token: str
    severity: int
    label: str
    pattern: str
    check: str | None = None
    #: What a text must hold for the pattern to be tried at all.
    hint: str | None = None


@dataclass(frozen=True)
class FieldRule:
    id: str
    token: str
    severity: int
    label: str
    #: A type that decides, a pattern over the field's hint, or the opt-out flag.
    type: str | None = None
    pattern: str | None = None
    opt_out: bool = False


# The rules in their order, which is part of their meaning.
# Patterns are as written for an engine whose \b, \w and \d are ASCII.
TEXT_RULES = (
    TextRule("aadhaar", "[MASK_AADHAAR]", 2, "Aadhaar number", r"\b[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}\b", "verhoeff", r"\d{4}[ -]?\d{4}[ -]?\d{4}"),
    TextRule("pan", "[MASK_PAN]", 2, "PAN card", r"\b[A-Z]{5}\d{4}[A-Z]\b", None, r"[A-Z]\d{4}[A-Z]"),
    TextRule("card", "[MASK_CARD]", 3, "Payment card", r"\b(?:\d[ -]?){13,19}\b", "card", r"\d(?:[ -]?\d){12}"),
    TextRule("ifsc", "[MASK_BANK]", 2, "IFSC code", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", None, r"[A-Z]0[A-Z0-9]"),
    TextRule("gstin", "[MASK_GSTIN]", 2, "GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b", None, r"\d[A-Z]{5}\d"),
    TextRule("passport", "[MASK_PASSPORT]", 2, "Passport number", r"\b[A-PR-WY][1-9]\d{6}\b", None, r"[A-Y][1-9]\d"),
    TextRule("email", "[MASK_EMAIL]", 1, "Email address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", None, r"@"),
    TextRule("phone_in", "[MASK_PHONE]", 1, "Phone number", r"(?:\+91[ -]?)?\b[6-9]\d{9}\b", None, r"[6-9]\d{9}"),
    TextRule("upi", "[MASK_UPI]", 2, "UPI handle", r"\b[a-zA-Z0-9.\-_]{2,}@(?:oksbi|okhdfcbank|okicici|okaxis|ybl|paytm|upi|apl|ibl)\b", None, r"@(?:ok|ybl|paytm|upi|apl|ibl)"),
    TextRule("jwt", "[MASK_TOKEN]", 3, "Session token / JWT", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", None, r"eyJ"),
    TextRule("apikey", "[MASK_SECRET]", 3, "API key / secret", r"\b(?:sk|pk|api|key|tok|ghp|AKIA)[-_A-Za-z0-9]{16,}\b"),
    TextRule("geo", "[MASK_COORD]", 3, "Geospatial coordinate", r"\b\d{1,3}\.\d{3,6}\s*[°]?\s*[NSns]\s*[,/]?\s*\d{1,3}\.\d{3,6}\s*[°]?\s*[EWew]\b", None, r"\d\.\d"),
    TextRule("dob", "[MASK_DOB]", 1, "Date of birth", r"\b(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2}\b", None, r"[/-](?:19|20)\d"),
)

# Field rules in order; the first that matches decides.
FIELD_RULES = (
    FieldRule("password", "[MASK_PASSWORD]", 3, "Password field", type="password"),
    FieldRule("otp", "[MASK_OTP]", 3, "One-time code", pattern=r"one-?time|\botp\b"),
    FieldRule("cc_field", "[MASK_CARD]", 3, "Card number field", pattern=r"cc-number|card-?number|cardnum"),
    FieldRule("cvc_field", "[MASK_CVC]", 3, "Card security code", pattern=r"cc-csc|\bcvv\b|\bcvc\b|security-?code"),
    FieldRule("aadhaar_field", "[MASK_AADHAAR]", 2, "Aadhaar field", pattern=r"aadhaar|aadhar|uidai"),
    FieldRule("ssn_field", "[MASK_GOVID]", 2, "Government ID field", pattern=r"\bssn\b|national-?id|gov-?id|pan-?(no|number)"),
    FieldRule("email_field", "[MASK_EMAIL]", 1, "Email field", type="email", pattern=r"\bemail\b"),
    FieldRule("tel_field", "[MASK_PHONE]", 1, "Phone field", type="tel", pattern=r"\b(phone|mobile|tel)\b"),
    FieldRule("opt_out", "[MASK_PII]", 3, "Site-declared sensitive region", opt_out=True),
)

# The short name stamped where a token does not fit.
SHORT_TOKENS = {
    "[MASK_PASSWORD]": "[PWD]", "[MASK_AADHAAR]": "[AADHAAR]", "[MASK_CARD]": "[CARD]", "[MASK_CVC]": "[CVC]",
    "[MASK_EMAIL]": "[EMAIL]", "[MASK_PHONE]": "[PHONE]", "[MASK_TOKEN]": "[TOKEN]", "[MASK_SECRET]": "[SECRET]",
    "[MASK_COORD]": "[GEO]", "[MASK_PASSPORT]": "[PASSPORT]", "[MASK_GSTIN]": "[GSTIN]", "[MASK_GOVID]": "[GOVID]",
    "[MASK_OTP]": "[OTP]", "[MASK_PII]": "[PII]", "[MASK_DOB]": "[DOB]", "[MASK_BANK]": "[BANK]",
    "[MASK_UPI]": "[UPI]", "[MASK_PAN]": "[PAN]",
}

#: A browser's scan passes over texts longer than this; here it is a limit that callers may ask for.
SCAN_CHARS = 20_000
#: Hits of this severity or more block what is about to leave.
SEVERE = 2

_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: White space as browsers' engines have it.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


# What is certainly a word character: a digit, a class of such characters, or one itself.
_WORDLY = r"(?:\\d|\[(?:\w-\w|\w)+\]|\w)"
# A class of ASCII letters, digits and signs without @, repeated before one: it can give nothing back that an @ would match.
_MAILBOX = re.compile(r"(\[(?:a-z|A-Z|0-9|[._%+\\-])+\](?:\+|\{\d+,\}))@")
_BEFORE, _AFTER = re.compile(rf"\\b(?=(?:\(\?:)?{_WORDLY})"), re.compile(rf"({_WORDLY}(?:\{{[\d,]+\}}|\+)?\)?)\\b")


def java(pattern: str) -> str:
    """The pattern for Java, whose \\b knows other letters than ASCII and whose \\s
    is ASCII. Beside a word character an edge is one lookaround, and what stands
    before an @ is taken whole or not at all."""
    pattern = _MAILBOX.sub(r"\1+@", pattern)
    pattern = _AFTER.sub(r"\1(?!\\w)", _BEFORE.sub(r"(?<!\\w)", pattern))
    return pattern.replace(r"\b", _WORD_EDGE).replace(r"\s", SPACE)
