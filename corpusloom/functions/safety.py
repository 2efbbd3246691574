"""Safety screening as native columns: personal data, toxic terms, licences, decisions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[\w%+.-]+@[\dA-Za-z.-]+\.(?:[A-Za-z]){2,}"
PHONE = r"\+?[0-9][0-9\s().-]{7,}"
IPV4 = r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){1,7}[0-9a-fA-F]{0,4}\b"
#: The same matches found faster: an address begins at a run of its characters or where the last one ended, a sign doesn't change how many numbers there are, digits are tried before the word border.
EMAIL_FAST = r"(?:\G|(?<![\w%+.-]))[\w%+.-]++@[\dA-Za-z.-]+\.(?:[A-Za-z]){2,}"
PHONE_FAST = r"[0-9][0-9\s().-]{7,}"
IPV4_FAST = rf"(?=[0-9]){IPV4}"
TOXIC_TERMS = ("abuse", "extremist", "hate", "kill", "nsfw", "racist", "terrorism", "violence")


def _if(may: Column, count: Column) -> Column:
    """count where a cheap test says that there may be matches, else 0; nulls stay."""
    return F.when(~may, F.lit(0)).otherwise(count).cast("long")


def email_count(text: Column) -> Column:
    return _if(text.contains("@"), F.regexp_count(text, F.lit(EMAIL_FAST)))


def phone_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PHONE_FAST)).cast("long")


def ipv4_count(text: Column) -> Column:
    """Dotted quads whose numbers are 0 to 255 without leading zeros."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    found = F.regexp_extract_all(text, F.lit(IPV4_FAST), F.lit(0))
    return _if(text.rlike(r"[0-9]\.[0-9]"), F.size(F.filter(found, lambda x: x.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))))


def ipv6_count(text: Column) -> Column:
    """Of what the pattern takes as addresses, the valid ones: the full form of eight groups (it can't hold '::')."""
    found = F.regexp_extract_all(text, F.lit(IPV6), F.lit(0))
    return _if(text.contains(":") & text.rlike("(?::[0-9a-fA-F]{1,4}){7}"), F.size(F.filter(found, lambda x: x.rlike(r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"))))


def ip_count(text: Column) -> Column:
    return ipv4_count(text) + ipv6_count(text)


def toxic_hits(text: Column, terms=TOXIC_TERMS) -> Column:
    low = F.lower(text)
    plain = bool(terms) and all(t.isalnum() for t in terms)
    return _if(reduce(or_, [low.contains(t) for t in terms]) if plain else low.isNotNull(), F.regexp_count(low, F.lit(rf"\b(?:{'|'.join(terms)})\b")))


def toxicity(text: Column, terms=TOXIC_TERMS, hits: Column | None = None) -> Column:
    return F.least(F.lit(1.0), (toxic_hits(text, terms) if hits is None else hits) / float(max(1, len(terms))))


def scrub_emails(text: Column, mark: str = "[EMAIL]") -> Column:
    return F.regexp_replace(text, EMAIL, mark)


def counts(text: Column, terms=TOXIC_TERMS) -> dict[str, Column]:
    """What ``screen`` reads, for a step of its own: an expression that is named several times in one step is computed several times."""
    return {"__emails": email_count(text), "__phones": phone_count(text), "__ips": ip_count(text), "__hits": toxic_hits(text, terms)}


def screen(text: Column, licence: Column | None = None, allowed=None, terms=TOXIC_TERMS, threshold: float | None = None, have_counts: bool = False) -> dict[str, Column]:
    """Columns of the safety screen, by name.  allowed: licences (any case) that pass; None lets all pass.  have_counts: the row has ``counts``."""
    emails, phones, ips, hits = (F.col(c) if have_counts else x for c, x in counts(text, terms).items())
    tox = toxicity(text, terms, hits)
    pii = (emails + phones + ips) > 0
    blocked = F.lit(False)
    if allowed:
        known = F.lower(F.trim(licence)) if licence is not None else F.lit(None).cast("string")
        blocked = ~F.coalesce(known.isin(*[a.lower() for a in allowed]), F.lit(False))
    drop_tox = tox >= threshold if threshold is not None else F.lit(False)
    reasons = F.array_compact(F.array(F.when(blocked, "license"), F.when(pii, "pii"), F.when(drop_tox, "toxicity")))
    reason = F.when(F.size(reasons) == 1, reasons[0]).when(F.size(reasons) > 1, "multi")
    return {
        "num_emails": emails,
        "num_phones": phones,
        "num_ips": ips,
        "toxicity": tox,
        "pii_detected": pii,
        "license_blocked": blocked,
        "toxicity_flag": tox > 0,
        "safety_decision": F.when(F.size(reasons) > 0, "drop").when(pii | (tox > 0) | blocked, "review").otherwise("keep"),
        "safety_reason": reason,
    }
