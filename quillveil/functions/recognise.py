"""Organisations and locations: shapes as Java regexes whose hits come from the JVM, and what gazetteers and context make of them.

Gazetteers are parameters; none is shipped.  Each recogniser's hits are put together and the longest at the
earliest place stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from .patterns import Pattern

STATES = ["NSW", "VIC", "QLD", "WA", "SA", "TAS", "NT", "ACT"]
# What the shapes of organisations and locations are made of, in the order that alternatives are tried.
STATE_NAMES = ["New South Wales", "Victoria", "Queensland", "Western Australia", "South Australia", "Tasmania", "Northern Territory", "Australian Capital Territory"]
SUFFIXES = [
    r"Pty\s*\.?\s*Ltd\.?", r"Pty\s+Limited", r"Ltd\.?", "Limited", "LLP", "Corporation", r"Corp\.?", r"Inc\.?", r"Co\.?", "Group", "Holdings", "Industries", "Associates", "Partners", "LLC",
    "Australia", "Australasia", "Clinic", r"Medical\s+Centre", r"Health\s+Service", r"Health\s+Services", "Lawyers", "Legal", "Solicitors", "Barristers", "Chambers", "Cooperative", "Co-operative",
    "Mutual", "Society", "Association", "Foundation", "Trust",
]
OFFICES = ["Department", "Ministry", "Office", "Bureau", "Commission", "Authority", "Service", "Agency", "Council", "Board", "Tribunal"]
HOSPITALS = ["Royal", r"St\.?", "Saint", "Mater", "Mercy", "Calvary", "Westmead", "Northern", "Western", "Eastern", "Southern", "Sydney", "Melbourne", "Brisbane", "Perth", "Adelaide", "Princess"]
FACILITIES = [r"Medical\s+Centre", r"Health\s+Service", r"Health\s+Services", r"Health\s+Care", "Healthcare", r"Aged\s+Care", r"GP\s+Clinic", r"Day\s+Hospital", r"Day\s+Surgery", r"Specialist\s+Centre"]
PRACTICES = ["Medical", "Dental", "General", "Specialist", "Family", "Group", "Surgical", "Orthopaedic", "Paediatric", "Veterinary", "Legal", r"Family\s+Law"]
NOT_ACRONYMS = frozenset(
    "ID PIN URL HTTP HTTPS API PDF DOC XML JSON CSV TSV HTML CSS JS OK YES NO TRUE FALSE USA UK EU UN WHO WTO NATO AM PM AEST AEDT ACST ACDT AWST GMT UTC MR MRS MS DR PROF PHD GP GPS ICU ED PT RN".split()
)
DIRECTIONS = [r"Greater\s+", r"Inner\s+", r"Outer\s+", r"Central\s+", r"North(?:ern)?\s+", r"South(?:ern)?\s+", r"East(?:ern)?\s+", r"West(?:ern)?\s+"]
CITIES = ["Sydney", "Melbourne", "Brisbane", "Perth", "Adelaide", "Canberra", "Hobart", "Darwin"]
MORE_CITIES = [*CITIES, "Newcastle", "Wollongong", "Geelong"]
INFORMAL = {
    "Greater": MORE_CITIES, "Inner": ["West", "East", "North", "South", "City", "Sydney", "Melbourne", "Brisbane"], "Outer": ["West", "East", "North", "South", "Sydney", "Melbourne", "Brisbane"],
    "Northern": ["Beaches", "Suburbs", "Rivers", "Territory", "Tablelands"], "Southern": ["Highlands", "Tablelands", "Suburbs", "Cross"], "Eastern": ["Suburbs", "Beaches", "Freeway"],
    "Western": ["Suburbs", "Sydney", "Melbourne", "Australia"],
}
NAMED = [
    "Top End", "Outback", "Goldfields", "Pilbara", "Kimberley", "Hunter Valley", "Yarra Valley", "Barossa Valley", "Margaret River", "McLaren Vale", "Mornington Peninsula", "Sunshine Coast",
    "Gold Coast", "Central Coast", "Blue Mountains", "Snowy Mountains", "Great Dividing Range", "Daintree", "Kakadu", "Red Centre", "Atherton Tableland",
]
REGION_TAILS = frozenset([*CITIES, "Australia", "Queensland", "Victoria", "Tasmania", "Territory"])
AMBIGUOUS_SUBURBS = frozenset([
    "Hill", "Beach", "Park", "Bay", "Point", "Heights", "Vale", "Grove", "Springs", "Junction", "Heads", "Plains", "River", "Lake", "Creek", "Wood", "Forest", "Garden", "View", "Cross", "North",
    "South", "East", "West", "Central", "Town", "City", "Eight Mile Plains", "Industrial Estate", "Estate", "The Gap", "Top End", "Outback", "Mountain", "Valley", "Plateau", "Federation", "Newtown",
])
#: spans of these categories keep organisations and locations off
SUPPRESSING = ["address", "name", "email", "url"]


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _spaced(words: Iterable[str]) -> str:
    return _any(w.replace(" ", r"\s+") for w in words)


_CAPITAL, _FIRST = r"[A-Z][\w'-]*", r"[A-Z][a-z][\w'-]*"
_FIRST_AND, _CAPITAL_AND = r"[A-Z][a-z][\w&'-]*", r"[A-Z][\w&'-]*"
# How the words above go together.
SHAPES: dict[str, str] = {
    "suffix": rf"{_FIRST_AND}(?:\s+(?:&\s+)?{_CAPITAL_AND}){{0,5}}\s+{_any(SUFFIXES)}",
    "department": rf"{_any(OFFICES)}\s+(?:of|for|on)\s+{_CAPITAL}(?:\s+(?:and|of|for)?\s*{_CAPITAL}){{0,6}}",
    "hospital": rf"(?:{_any(HOSPITALS)}\s+)+(?:[A-Z][\w']*\s+)*Hospital",
    "university": rf"University\s+of\s+{_CAPITAL}(?:\s+{_CAPITAL}){{0,3}}|(?:{_CAPITAL}\s+){{1,3}}University",
    "facility": rf"(?:{_FIRST}\s+){{1,4}}{_any(FACILITIES)}",
    "partners": rf"[A-Z][\w'-]+(?:\s*,\s*[A-Z][\w'-]+)*\s+(?:&|and)\s+(?:Partners|Associates|Co\.?)(?:\s+(?:Lawyers|Legal|Solicitors|Barristers|Chambers))?",
    "practice": rf"(?:{_FIRST_AND}\s+){{0,4}}{_any(PRACTICES)}\s+Practice",
    "acronym": r"[A-Z]{2,8}",
    "state": _any(STATES),
    "state_name": _any(STATE_NAMES),
    "postcode": r"\d{4}",
    "suburb": r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}",
    "region": rf"{_any(DIRECTIONS)}{_CAPITAL}(?:\s+{_CAPITAL}){{0,2}}",
    "informal": "|".join([*(rf"{head}\s+{_any(tails)}" for head, tails in INFORMAL.items()), r"Mid[\s-]North\s+Coast", r"Far\s+North\s+(?:Queensland|Coast)"]),
    "named": rf"(?i:(?:the\s+)?{_spaced(NAMED)})",
    "cbd": rf"{_any(MORE_CITIES)}\s+CBD|CBD\s+of\s+{_any(CITIES)}|{_any(CITIES)}\s+Central\s+Business\s+District",
}
ORGANISATIONS = ["gazetteer", "suffix", "department", "hospital", "university", "facility", "partners", "practice", "acronym"]
LOCATIONS = ["state", "state_name", "postcode", "suburb", "region", "informal", "named", "cbd"]
# a text without these can't match
_NEEDS = {"hospital": "Hospital", "university": "University", "practice": "Practice", "cbd": "CBD|Central", "partners": "Partners|Associates|Co", "postcode": r"\p{Nd}{4}"}


def patterns(only: Iterable[str] | None = None) -> list[Pattern]:
    """The shapes as patterns, by recogniser; those that need a regex."""
    names = [n for n in (*ORGANISATIONS, *LOCATIONS) if n in SHAPES and (only is None or n in only)]
    return [Pattern(n, rf"(?U)()(\b(?:{SHAPES[n]})\b)", _NEEDS.get(n, "[A-Za-z]" if n == "named" else "[A-Z]")) for n in names]


@dataclass
class Gazetteers:
    """Names and places, small enough to be known to every task.

    names: full organisation names; acronyms: to their expansion; suburbs: to their states; postcodes: to their (suburb, state).
    """

    names: list[str] = field(default_factory=list)
    acronyms: dict[str, str] = field(default_factory=dict)
    suburbs: dict[str, set[str]] = field(default_factory=dict)
    postcodes: dict[str, set[tuple[str, str]]] = field(default_factory=dict)

    #: entries of a gazetteer at most
    LIMIT = 500_000

    def __post_init__(self) -> None:
        for what in (self.names, self.acronyms, self.suburbs, self.postcodes):
            if len(what) > self.LIMIT:
                raise ValueError(f"a gazetteer of {len(what)} entries, more than the {self.LIMIT} that are sent to every task")


class Recogniser:
    """Puts one text's shape hits and gazetteers together; made once in a task."""

    def __init__(self, gazetteers: Gazetteers, only: Iterable[str] | None = None):
        self.given, self.only = gazetteers, set(only) if only is not None else {*ORGANISATIONS, *LOCATIONS}
        self.suburbs = {s.lower() for s in gazetteers.suburbs}
        self.heads: dict[str, list[str]] = {}
        for n in gazetteers.names:
            if len(n) >= 3:
                self.heads.setdefault(n.split(maxsplit=1)[0], []).append(n)
        # the first words of names, longest first, found wherever a word begins
        self.first = re.compile(r"(?<!\w)(?=(" + "|".join(map(re.escape, sorted(self.heads, key=len, reverse=True))) + "))") if self.heads else None
        self.state = re.compile(r"\b" + _any(STATES) + r"\b")
        self.digits = re.compile(r"\b\d{4}\b")

    def _names(self, text: str) -> Iterator[tuple[int, int, bool]]:
        if self.first is None or "gazetteer" not in self.only:
            return
        for m in self.first.finditer(text):
            a = m.start()
            for head in {m.group(1), *(h for h in self.heads if m.group(1).startswith(h))}:
                for name in self.heads[head]:
                    b = a + len(name)
                    if text.startswith(name, a) and _in_word(text, b - 1) != _in_word(text, b):
                        yield a, b, True

    def _acronym(self, text: str, low: str, a: int, b: int) -> bool:
        word = text[a:b]
        if word in NOT_ACRONYMS or word in STATES or word not in self.given.acronyms:
            return False
        around, full = low[max(0, a - 200) : b + 200], self.given.acronyms[word].lower()
        start = " ".join(full.split()[:2])
        return full in around or bool(start) and start in around

    def _postcode(self, text: str, a: int, b: int) -> bool:
        known = self.given.postcodes.get(text[a:b])
        if not known:
            return False
        around = text[max(0, a - 60) : b + 60]
        return bool(self.state.search(around)) or any(s.lower() in around.lower() for s, _ in known)

    def _suburb(self, text: str, a: int, b: int) -> bool:
        word = text[a:b]
        if word.lower() not in self.suburbs:
            return False
        behind = text[b : b + 30]
        return word not in AMBIGUOUS_SUBURBS or bool(self.state.search(behind) or self.digits.search(behind))

    def _region(self, text: str, a: int, b: int) -> bool:
        tail = text[a:b].rsplit(maxsplit=1)[-1]
        return tail.lower() in self.suburbs or tail.upper() in STATES or tail in REGION_TAILS

    def spans(self, text: str, hits: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """Organisations and locations (start, end, certain); hits: (recogniser, start, end, ...) of the shapes."""
        low = text.lower() if any(h[0] == "acronym" for h in hits) else ""
        orgs, places = list(self._names(text)), []
        for name, a, b, *_ in hits:
            if name not in self.only:
                continue
            if name == "acronym":
                if self._acronym(text, low, a, b):
                    orgs.append((a, b, True))
            elif name in ORGANISATIONS:
                orgs.append((a, b, False))
            elif name not in ("postcode", "suburb", "region") or getattr(self, "_" + name)(text, a, b):
                places.append((a, b, True))
        return _apart(orgs), _apart(places)


def _in_word(text: str, at: int) -> bool:
    return at < len(text) and (text[at].isalnum() or text[at] == "_")


def _apart(spans: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    """The longest at the earliest place, then on from its end; of equal ranges the first."""
    out, end = [], -1
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out
