"""Policies that report every violation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scan import SEVERE_RULES, has_severe, scan_text
from ..functions.text import payload

# Codes and sentences of the policies.
MISSING, UNVERIFIED, NOT_ENCODED, UNHASHED, IN_METADATA = "MISSING_ATTESTATION", "REDACTION_NOT_VERIFIED", "IMAGE_NOT_ENCLAVE_ENCODED", "IMAGE_UNHASHED", "PII_IN_METADATA:"
NO_ATTESTATION = "no client sanitisation attestation"
NO_UNIFORMITY = "client did not verify redaction uniformity"
NOT_INLINE = "image is not an inline sanitised buffer"
HASH_DIFFERS = "attestation hash does not match the received bytes"
UNDECODABLE = "image is not decodable base64"
MOST_IMAGE_BYTES = 8 * 1024 * 1024
BLOCKED_FIELD, BLOCKED_TEXT = "BLOCKED_CREDENTIAL_FIELD", "BLOCKED_PII_PAYLOAD"
RESULT_CODES = ("UNKNOWN_OP", "NO_ELEMENT_AT_POINT", "NO_FRAME_HANDLED_ACTION", "DISPATCH_ERROR")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def firewall(attested: Column, sanitised: Column, uniform: Column, image: Column, sha256: Column, metadata: Column, *, limit: int | None = None) -> Column:
    """struct<allowed, violations, scanned_chars> of an envelope about to leave.
    ``attested``: whether it has an attestation at all; ``metadata``: its JSON
    without the image, of which any length is scanned unless a ``limit`` is
    given: a browser's firewall lets metadata of more than 20,000 characters pass."""
    found = scan_text(metadata, rules=SEVERE_RULES, limit=limit)
    has = F.coalesce(attested, F.lit(False))
    named = F.array_compact(F.array(
        F.when(~(has & _true(sanitised)), MISSING),
        F.when(has & ~_true(uniform), UNVERIFIED),
        F.when(~_true(image.startswith("data:image/webp;base64,")), NOT_ENCODED),
        F.when(has & (F.length(F.coalesce(image, F.lit(""))) > 0) & (F.length(F.coalesce(sha256, F.lit(""))) == 0), UNHASHED),
    ))
    leaks = F.transform(found, lambda h: F.concat(F.lit(IN_METADATA), h["rule_id"]))
    violations = F.concat(named, leaks)
    return F.struct((F.size(violations) == 0).alias("allowed"), violations.alias("violations"), F.length(metadata).alias("scanned_chars"))


def server_policy(sanitised: Column, uniform: Column, image: Column, claimed: Column, *, most: int = MOST_IMAGE_BYTES) -> Column:
    """struct<status, reasons, sha256, bytes> of a received envelope: 422 if its
    image can't be decoded, 403 with every reason, else 200. A hash is compared
    only where one is claimed."""
    data = F.try_to_binary(F.when(F.instr(image, ",") > 0, payload(image)), F.lit("base64"))
    digest = F.sha2(data, 256)
    size = F.octet_length(data)
    reasons = F.array_compact(F.array(
        F.when(~_true(sanitised), NO_ATTESTATION),
        F.when(~_true(uniform), NO_UNIFORMITY),
        F.when(~_true(image.startswith("data:image/")), NOT_INLINE),
        F.when(size > most, F.lit(f"frame exceeds {most} bytes")),
        F.when((F.length(claimed) > 0) & (claimed != digest), HASH_DIFFERS),
    ))
    status = F.when(data.isNull(), 422).when(F.size(reasons) > 0, 403).otherwise(200)
    return F.struct(status.alias("status"), F.when(data.isNull(), F.array(F.lit(UNDECODABLE))).otherwise(reasons).alias("reasons"), digest.alias("sha256"), size.alias("bytes"))


def write_guard(op: Column, field_severity: Column, text: Column) -> Column:
    """Why an action may not be done; null if it may. Only typing is guarded."""
    return F.when(op == "type", F.when(F.coalesce(field_severity, F.lit(0)) >= 3, BLOCKED_FIELD).when(has_severe(text), BLOCKED_TEXT))


def result(op: Column, guard: Column, found: Column, by_point: Column) -> Column:
    """struct<ok, op, code> of a dispatched action."""
    known = op.isin("click", "type", "press", "select", "scroll")
    code = F.when(~known, "UNKNOWN_OP").when((op != "scroll") & ~found, F.when(by_point, "NO_ELEMENT_AT_POINT").otherwise("NO_FRAME_HANDLED_ACTION")).otherwise(guard)
    return F.struct(code.isNull().alias("ok"), op.alias("op"), code.alias("code"))


def verdict_text(verdict: Column) -> Column:
    """struct<state, title, text> shown for a firewall's verdict; a null one means that nothing was sent."""
    # What is shown.
    said = lambda state, title, text: F.struct(F.lit(state).alias("state"), F.lit(title).alias("title"), text.alias("text"))
    why = F.coalesce(F.nullif(F.array_join(verdict["violations"], ", "), F.lit("")), F.lit("Policy check failed"))
    return (
        F.when(verdict.isNull(), said("idle", "Egress firewall idle", F.lit("Nothing has been sent to a planner.")))
        .when(verdict["allowed"], said("ok", "Egress allowed", F.format_string("%d metadata characters checked, no PII found", verdict["scanned_chars"])))
        .otherwise(said("bad", "Egress blocked", why))
    )
