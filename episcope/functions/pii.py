"""Personal-data patterns and masks (PII-1, PII-2) as column expressions.

The patterns are unanchored, as in the source, so a CPF also reports as RG
(the RG shape matches inside it). ``(?U)`` makes ``\\d``/``\\s`` Unicode-aware,
matching Python's ``re`` on text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: detection patterns, labels and masks, in checking order ---
CPF_PATTERN = r"\d{3}\.\d{3}\.\d{3}-\d{2}"
RG_PATTERN = r"\d{1,2}\.\d{3}\.\d{3}-\d{1,2}"
PHONE_PATTERN = r"\(\d{2}\)\s?\d{4,5}-?\d{4}"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PII_RULES = (
    ("CPF", CPF_PATTERN, "***.***.***-**"),
    ("RG", RG_PATTERN, "**.***.***-*"),
    ("Telefone", PHONE_PATTERN, "(**) ****-****"),
    ("Email", EMAIL_PATTERN, "***@***.***"),
)
# Characters every match of a rule must contain: a cheap substring test skips the
# regex on texts that cannot match (most texts have no '@', for example).
REQUIRED_CHARS = {"CPF": (".", "-"), "RG": (".", "-"), "Telefone": ("(", ")"), "Email": ("@", ".")}


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def _may_match(text: Column, label: str) -> Column:
    cond = None
    for ch in REQUIRED_CHARS[label]:
        c = text.contains(ch)
        cond = c if cond is None else cond & c
    return cond


def _hit(text: Column, label: str, pattern: str) -> Column:
    return F.when(_may_match(text, label), text.rlike(_u(pattern))).otherwise(F.lit(False))


def pii_types(text: Column) -> Column:
    """PII-1: ARRAY<STRING> of the kinds found, in the order CPF, RG, Telefone, Email."""
    return F.array_compact(F.array(*[
        F.when(_hit(text, label, p), F.lit(label)) for label, p, _ in PII_RULES
    ]))


def has_pii(text: Column) -> Column:
    out = None
    for label, p, _ in PII_RULES:
        hit = _hit(text, label, p)
        out = hit if out is None else out | hit
    return out


def anonymize(text: Column) -> Column:
    """PII-2: replace CPF → RG → phone → e-mail with fixed masks, in that order."""
    out = text
    for _, p, mask in PII_RULES:
        out = F.regexp_replace(out, _u(p), mask.replace("$", r"\$"))
    return out


def scrub(text: Column) -> Column:
    """PII-3: anonymize only texts where something was detected."""
    return F.when(has_pii(text), anonymize(text)).otherwise(text)
