"""The categories' regular expressions, in Java's dialect.

Group 1 is what stands before the value (a label, often nothing); each other group is
a value.  The order is the order of detection.
"""

from __future__ import annotations

from typing import NamedTuple

#: what counts as a blank: Unicode's white space and the four separators U+001C to U+001F
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def unicode(regex: str) -> str:
    """A regex whose blanks, digits and word bounds are Unicode's, not ASCII's alone, on any JDK."""
    return regex.replace(r"\s", BLANK).replace(r"\d", r"\p{Nd}").replace(r"\b", r"(?U:\b)")


class Pattern(NamedTuple):
    category: str
    regex: str
    needs: str  # a cheap regex without which a text can't match


_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_WORD = "[A-Z]{3,12}"
_EXT = r"(?:\s*(?:x|ext\.?|extension)\s*\d{1,6})?"
_NAME = r"[A-Z](?:[a-z]+)?(?:['-][A-Z][a-z]+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)"
_HANDLE = r"[a-zA-Z0-9][a-zA-Z0-9_-]*(?:\.[a-zA-Z0-9][a-zA-Z0-9_-]*)*"
_SEPARATED = r"(?=[a-zA-Z0-9._-]*[._-])(?=[a-zA-Z0-9._-]*[a-zA-Z])"
_DIGITED = r"(?=[a-zA-Z0-9._-]*\d)(?=[a-zA-Z0-9._-]*[a-zA-Z])"

# The shapes of the twenty categories, as the data model defines them; \s, \d and \b stand for Unicode's (see `unicode`).
PATTERNS = [
    Pattern("abn", r"()((?<!\d)\d{2}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3}(?!\d))", r"\d{2}"),
    Pattern("tfn", r"()((?<!\d)\d{3}[\s-]?\d{3}[\s-]?\d{2,3}(?!\d))", r"\d{3}"),
    Pattern("acn", r"()((?<!\d)\d{3}[\s-]?\d{3}[\s-]?\d{3}(?!\d))", r"\d{3}"),
    Pattern("medicare", r"()((?<!\d)\d{4}[\s-]?\d{5}[\s-]?\d(?:[\s-]?\d)?(?!\d))", r"\d{4}"),
    Pattern("bsb_account", r"()((?<!\d)\d{3}[\s-]?\d{3}(?!\d))", r"\d{3}"),
    Pattern("patient_id", r"(?i)(\b(?:patient\s*(?:id|identifier|number|no\.?)|pt\s*id)\s*[:#-]?\s*)([A-Z0-9][A-Z0-9-]{4,24})\b", "(?i)patient|pt"),
    Pattern("medical_record_number", r"(?i)(\b(?:mrn|medical\s*record\s*(?:number|no\.?)|hospital\s*(?:urn|ur|number|no\.?))\s*[:#-]?\s*)([A-Z0-9][A-Z0-9-]{4,24})\b", "(?i)mrn|medical|hospital"),
    Pattern("healthcare_identifier", r"(?i)(\b(?:ihi|individual\s*healthcare\s*identifier|healthcare\s*identifier)\s*[:#-]?\s*)(\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4})\b", r"\d{4}"),
    Pattern("name", r"(\b(?i:(?:contact|patient|client|customer|attn|attention|emergency\s*contact|next\s*of\s*kin|account\s*holder|policy\s*holder|applicant|guardian))\s*[:#-]\s*)(" + _NAME + r"(?:\s+" + _NAME + r"){1,3})\b", r"[:#-]\s*[A-Z]"),
    Pattern("passport", r"()(\b[A-Z]{1,2}\d{7}\b)", r"\d{7}"),
    Pattern("driver_licence", r"()(\b[A-Z]{0,2}\d{6,9}\b)", r"\d{6}"),
    Pattern("centrelink_crn", r"()(\b\d{9}[A-Z]\b)", r"\d{9}"),
    Pattern(
        "phone",
        r"(?i)()((?<!\d)(?:"
        r"(?:\+61|0061)[\s.-]?(?:[2-578][\s.-]?\d{4}[\s.-]?\d{4}|[45]\d{2}[\s.-]?\d{3}[\s.-]?\d{3})"
        r"|\(0[2-578]\)[\s.-]?\d{4}[\s.-]?\d{4}"
        r"|0[2-578][\s.-]\d{4}[\s.-]?\d{4}"
        r"|04\d{2}[\s.-]?\d{3}[\s.-]?\d{3}"
        r"|\+\d{1,3}[\s.-]?\(\d{2,4}\)[\s.-]?\d{3,5}[\s.-]?\d{3,4}" + _EXT +
        r"|\+\d{1,3}\(0\)[\s.-]?\d{1,4}[\s.-]?\d{3,4}[\s.-]?\d{3,4}"
        r"|\+\d{1,3}[\s.-]?\d{3,5}[\s.-]\d{3,4}(?:[\s.-]\d{2,6})?" + _EXT +
        r"|\+\d{1,3}(?:[\s.-]\d{2,5}){2,4}"
        r"|\d[\s.-]?\(\d{2,4}\)[\s.-]?\d{3,5}[\s.-]?\d{3,4}" + _EXT +
        r"|\(\d{2,4}\)[\s.-]?\d{3,5}[\s.-]?\d{3,4}" + _EXT +
        r"|\d{3}-\d{3}-\d{4}|\d{4}[\s.-]\d{4}|\d{3}\.\d{3}\.\d{4}"
        r"|0\d{2,4}[\s.]\d{3,4}[\s.]\d{3,4}"
        r")(?!\d))",
        r"\d{3}|\+\d",
    ),
    Pattern("email", r"()((?<![A-Za-z0-9_%+-])[A-Za-z0-9](?:[A-Za-z0-9_.+-]*[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9]))", "@"),
    Pattern(
        "url",
        r"(?i)()((?U:\b)(?:https?://|tps://|www\.)(?U:[\w./\-?=&%#:@]+)"
        r"|(?U:(?<![@\w]))(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?:/(?U:[\w./\-?=&%#:@]*))?(?![A-Za-z0-9_-]))",
        r"(?i)://|www\.|\.[A-Z]",
    ),
    Pattern(
        "address",
        r"(?i)()(\b\d{1,6}\s+(?:[A-Za-z][A-Za-z'.-]*\s+){0,8}"
        r"(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Terrace|Tce|Way|Close|Crescent|Cres|Highway|Hwy|Parade|Pde|Square|Sq|Circuit|Cct|Track|Trail|Trl)\b"
        r"(?:,?\s+(?:[A-Za-z][A-Za-z'.-]*|NSW|VIC|QLD|WA|SA|TAS|ACT|NT|\d{4})){0,8})",
        r"\d\s+[A-Za-z]",
    ),
    Pattern(
        "username",
        r"(\b(?:username|handle|login|screen\s*name|account\s*name)s?\s*[:=]\s*)([a-zA-Z0-9][a-zA-Z0-9._-]{2,31})\b"
        r"|(?U:(?<![\w@.]))(@[a-zA-Z][a-zA-Z0-9._-]{2,31}"
        r"|(?=[a-zA-Z0-9._-]{3,32}(?U:(?![\w-])))" + _SEPARATED + _HANDLE +
        r"|(?=[a-zA-Z0-9._-]{5,32}(?U:(?![\w-])))" + _DIGITED + _HANDLE + r")(?U:(?![\w-]))"
        r"|(?<=\.\.\.)((?=[a-zA-Z0-9._-]{3,32}(?=\.\.\.))" + _SEPARATED + _HANDLE +
        r"|(?=[a-zA-Z0-9._-]{5,32}(?=\.\.\.))" + _DIGITED + _HANDLE + r")(?=\.\.\.)",
        r"[@._\-\d:=]",
    ),
    Pattern(
        "generic_id",
        r"(?i)(\b(?:student|user|account|member|client|customer|case|pin|code|reference|ref|id(?:entifier)?|username)\s*(?:id|number|no\.?)?\s*[:#-]\s*)([A-Z0-9][A-Z0-9._-]{2,32})\b"
        r"|((?<![A-Z0-9])[A-Z]{2,8}:[A-Z0-9]{5,18}(?![A-Z0-9])"
        r"|(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
        r"|(?<![A-Z0-9])[A-Z]{1,3}(?:\s+\d{2}){3,4}\s+[A-Z](?![A-Z0-9])"
        r"|(?<![A-Z0-9])(?-i:(?=[A-Z0-9]{6,18}\b)(?=[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{6,18})(?![A-Z0-9])"
        r"|(?<!\d)\d{1,2}(?:,\d{1,2}){2,5},?(?!\d)"
        r"|(?<!\d)\d{10,16}(?!\d))",
        r"[\d:#-]",
    ),
    Pattern(
        "date",
        r"(?i)()(\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}:\d{2}(?::\d{2})?|\d{1,2}\s*[A-Z]\s*\d{2}"
        r"|(?:half past|quarter (?:past|to))\s+\d{1,2}|\d{1,2}\s+o'clock"
        # a word for the month, whatever it is, in three orders; the month's own name after an ordinal with a full stop
        r"|" + _WORD + r"[/-]\d{1,4}|" + _WORD + r"\s+\d{1,2}[A-Z]{0,3}\.?,?\s+\d{2,4}|\d{1,2}[A-Z]{1,3}\s+" + _WORD + r"\s+\d{2,4}"
        r"|\d{1,2}\s+" + _WORD + r"\s+" + _WORD + r"\s+\d{1,2}|\d{1,2}(?:st|nd|rd|th)?\.?\s+" + _MONTH + r"\s+\d{2,4})(?!\d))",
        r"\d",
    ),
    Pattern("ip_address", r"()(\b(?:" + _OCTET + r"\.){3}" + _OCTET + r"\b)", r"\d\.\d"),
]

PATTERNS = [p._replace(regex=unicode(p.regex), needs=unicode(p.needs)) for p in PATTERNS]
CATEGORIES = [p.category for p in PATTERNS]

# Tokens that are never user names, reserved host endings.
BENIGN_TOKENS = ["snake_case_tokens", "markdown_headers", "service_timeout_ms", "retry_limit", "enable_cache", "log_level"]
BENIGN_NAME = unicode(r"(?i)^(?:alpha|beta|gamma|omega|filler|batch|shard|build|train)\d{3,}$")
RESERVED_HOSTS = [".invalid", ".test", ".example"]
