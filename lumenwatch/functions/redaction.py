"""Masking of secrets and personal data in text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is masked, in this order: (name, pattern, replacement). Cards come after the secrets, before the last four.
PATTERNS = [
    ("secret", r"(?i)(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{0,40}(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|authorization)[A-Za-z0-9_-]{0,40}(?:\\?[\"'])?\s*[:=]\s*)(?:(?:Bearer|Basic|SSWS)\s+)?(?:\\?[\"'][^\"'\\]*\\?[\"']|[^\s,;}\]]+)", "$1<REDACTED>"),
    ("high_entropy", r"\b(?:sk-[A-Za-z0-9_-]{10,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|Bearer\s+[A-Za-z0-9._-]{12,})\b", "<REDACTED>"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*", "<JWT>"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b", "<AWS_KEY>"),
    ("aws_secret", r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[a-z])(?=[A-Za-z0-9/+]{0,39}[0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", "<AWS_SECRET>"),
    ("ssh_key", r"(?s)-----BEGIN (RSA|OPENSSH|EC|DSA)? PRIVATE KEY-----.*?-----END (RSA|OPENSSH|EC|DSA)? PRIVATE KEY-----", "<SSH_KEY>"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "<EMAIL>"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "<SSN>"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "<IPV6>"),
]
CARD, CARD_LABEL = r"(?<!\d)(?:\d[ -]?){12,16}\d(?!\d)", "CC_NUMBER"
#: Secrets of the list above; the others are personal data.
SECRETS = 6


def java(pattern: str) -> Column:
    """The pattern with letters, digits and word edges of all scripts."""
    return F.lit("(?U)" + pattern)


def _is_card(candidate: Column) -> Column:
    digits = F.regexp_replace(candidate, "[^0-9]", "")
    return F.length(digits).between(13, 16) & F.call_function("luhn_check", digits)


def mask_cards(text: Column) -> Column:
    """Numbers of 13 to 16 digits, single blanks or hyphens allowed between them, that pass the Luhn test."""
    between, found = F.split(text, CARD, -1), F.regexp_extract_all(text, F.lit(CARD), F.lit(0))
    label = lambda c: F.when(c.isNull(), "").when(_is_card(c), CARD_LABEL).otherwise(c)
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.zip_with(between, found, lambda t, c: F.concat(t, label(c))), ""))


def mask(text: Column) -> Column:
    """The text without secrets and personal data; a null text becomes empty."""
    text = F.coalesce(text, F.lit(""))
    for _, pattern, replacement in PATTERNS[:SECRETS]:
        text = F.regexp_replace(text, java(pattern), F.lit(replacement))
    text = mask_cards(text)
    for _, pattern, replacement in PATTERNS[SECRETS:]:
        text = F.regexp_replace(text, java(pattern), F.lit(replacement))
    return text


def hits(text: Column) -> dict[str, Column]:
    """How often each pattern, and a card number, occurs."""
    text = F.coalesce(text, F.lit(""))
    counts = {name: F.regexp_count(text, java(pattern)).cast("long") for name, pattern, _ in PATTERNS}
    return counts | {"card": F.size(F.filter(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), _is_card)).cast("long")}


#: What looks like an IPv4 address, what is one, and the networks inside an organisation.
ADDRESS = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
VALID_ADDRESS = r"^(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
INTERNAL = r"^(?:10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|127\.|169\.254\.)"


def address_tokens(text: Column) -> Column:
    """IPv4 addresses become <IP:internal> or <IP:public>; what looks like one and isn't stays, so it is taken as a whole."""
    text = F.coalesce(text, F.lit(""))
    told = lambda a: F.when(~a.rlike(VALID_ADDRESS), a).when(a.rlike(INTERNAL), "<IP:internal>").otherwise("<IP:public>")
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), told), F.array(F.lit("")))
    return F.when(~text.rlike(ADDRESS), text).otherwise(F.array_join(F.zip_with(F.split(text, ADDRESS), found, lambda a, b: F.concat(a, b)), ""))
