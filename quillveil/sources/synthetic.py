"""Made-up documents with their labels: a row's content depends on the seed and its number alone, so any part can be made anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import MEDICARE

PROFILES = ["mixed", "government", "clinical", "negative"]
_FIRST = ["Ava", "Noah", "Mia", "Oliver", "Isla", "Jack", "Grace", "Leo", "Zoe", "Henry"]
_LAST = ["Nguyen", "Smith", "Patel", "Brown", "Wilson", "Taylor", "Singh", "Martin", "O'Connor", "Lee"]
_STREETS = ["King Street", "George Street", "Collins Street", "Queen Street", "Elizabeth Street"]
_SUBURBS = ["Sydney", "Melbourne", "Brisbane", "Perth", "Adelaide"]


class _Draw:
    """Draws that depend on the seed, the row's number and the draw's name."""

    def __init__(self, seed: int, number: Column):
        self.seed, self.number = seed, number

    def below(self, name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(name), self.number), F.lit(n))

    def between(self, name: str, a: int, b: int) -> Column:
        return self.below(name, b - a + 1) + a

    def of(self, name: str, values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.below(name, len(values)) + 1).cast("int"))

    def chance(self, name: str, percent: int) -> Column:
        return self.below(name, 100) < percent


def _label(category: str, value: Column, valid: bool = True) -> Column:
    return F.struct(F.lit(category).alias("category"), value.cast("string").alias("value"), F.lit(valid).alias("valid"))


def corpus(spark: SparkSession, n: int, profile: str = "mixed", seed: int = 42) -> DataFrame:
    """(id, text, profile, labels) of n documents.

    mixed has every kind of identifier, government and clinical some, negative none; one in five of the others has a control number whose check fails.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; known: {', '.join(PROFILES)}")
    i = F.col("id")
    d = _Draw(seed, i)
    every, never = profile in ("mixed", "clinical"), profile == "clinical"
    first, last = d.of("first", _FIRST), d.of("last", _LAST)
    name = F.concat(first, F.lit(" "), last)
    dob = F.format_string("%02d/%02d/%d", d.between("day", 1, 28), d.between("month", 1, 12), d.between("year", 1940, 2008))
    address = F.format_string("%d %s, %s NSW %d", d.between("no", 1, 250), d.of("street", _STREETS), d.of("suburb", _SUBURBS), d.between("code", 2000, 2999))
    email = F.format_string("%s.%s%d@example.gov.au", F.lower(first), F.replace(F.lower(last), F.lit("'"), F.lit("")), i)
    phone = F.format_string("04%d", d.between("phone", 10_000_000, 99_999_999))
    licence, passport = F.format_string("NSW%d", d.between("dl", 100_000, 999_999)), F.format_string("N%d", d.between("pass", 1_000_000, 9_999_999))
    crn, bsb = F.format_string("%dA", d.between("crn", 100_000_000, 999_999_999)), F.format_string("%d-%d", d.between("b1", 100, 999), d.between("b2", 100, 999))
    account = d.between("account", 10_000_000, 99_999_999).cast("string")
    patient, mrn = F.format_string("PID-%d", d.between("pid", 100_000, 999_999)), F.format_string("MRN %d", d.between("mrn", 1_000_000, 9_999_999))
    tfn, abn, acn, medicare, ihi = (F.lit(x) for x in ("123 456 782", "53 004 085 616", "004 085 616", "2123 45670 1", "8003 6000 0000 0000"))
    yes, no = F.lit(True), F.lit(False)

    def when(name: str, percent: int, off: bool = False) -> Column:
        return no if off else yes if every else d.chance(name, percent)

    def said(text: str, *values: Column) -> Column:
        return F.format_string(text, *values)

    parts = [
        (when("p1", 70), said("Patient %s attended review.", name), [_label("name", name)]),
        (when("p2", 60), said("Date of birth: %s.", dob), [_label("date_of_birth", dob)]),
        (when("p3", 50, never), said("Residential address is %s.", address), [_label("address", address)]),
        (when("p4", 60, never), said("Contact email %s and mobile %s.", email, phone), [_label("email", email), _label("phone", phone)]),
    ]
    if profile in ("mixed", "government"):
        parts += [
            (yes, said("TFN %s; ABN %s; ACN %s.", tfn, abn, acn), [_label("tfn", tfn), _label("abn", abn), _label("acn", acn)]),
            (
                yes, said("Medicare number %s; driver licence %s; passport %s; CRN %s.", medicare, licence, passport, crn),
                [_label("medicare", medicare), _label("driver_licence", licence), _label("passport", passport), _label("crn", crn)],
            ),
            (yes, said("Bank details BSB %s, account %s.", bsb, account), [_label("bsb_account", bsb)]),
        ]
    if profile in ("mixed", "clinical"):
        parts.append((yes, said("Patient ID: %s; Medical Record Number: %s; IHI %s.", patient, mrn, ihi), [_label("patient_id", patient), _label("medical_record_number", mrn), _label("healthcare_identifier", ihi)]))
    if profile == "negative":
        parts = [(yes, F.lit(t), []) for t in ("This note holds no personal identifiers.", "Codes ABC-123 and XYZ-999 are internal, not people's records.", "Only aggregate counts were reviewed.")]
    else:
        parts.append((d.chance("control", 20), F.lit("Control number TFN 123 456 789 fails its check and is not valid."), [_label("tfn", F.lit("123 456 789"), False)]))
    none = F.array().cast("array<struct<category:string,value:string,valid:boolean>>")
    text = F.array_join(F.array(*[F.when(c, t) for c, t, _ in parts]), " ")
    labels = F.concat(none, *[F.when(c, F.array(*own)).otherwise(none) for c, _, own in parts if own])
    return spark.range(n).select(F.format_string(f"synthetic-{profile}-%06d", i).alias("id"), text.alias("text"), F.lit(profile).alias("profile"), labels.alias("labels"))


def medicare_number(eight: Column) -> Column:
    """Ten digits that pass the Medicare check: eight given ones, the check digit, and an issue number of 1."""
    total = F.lit(0)
    for k, w in enumerate(MEDICARE, 1):
        total = total + F.substring(eight, k, 1).cast("int") * w
    return F.concat(eight, (total % 10).cast("string"), F.lit("1"))


_NOTES = [
    ("discharge", "DISCHARGE SUMMARY\nPatient: %s\nDOB: %s\n%s\nMedicare: %s\nAdmitted with chest pain and discharged home after observation. Follow up by phone on %s.\nAddress: %s"),
    ("referral", "Dear colleague, please see %s (DOB %s, %s, Medicare %s) for assessment of chronic knee pain. Contact %s, lives at %s."),
    ("progress", "Progress note: %s, born %s, %s, Medicare %s. Wound healing well, no fever. Mobile %s. Resident of %s."),
    ("pathology", "PATHOLOGY REPORT\nName: %s  DOB: %s\nRecord: %s\nMedicare No: %s\nFull blood count within normal limits. Result phoned to %s. Postal address %s."),
    ("telehealth", "Telehealth consult with %s (DOB %s). Record %s, Medicare card %s. Script sent; callback number %s; home address %s."),
]


def medical_notes(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(id, text, template, labels) of n clinical notes, by five templates in turn; all Medicare numbers pass their check."""
    i = F.col("id")
    d = _Draw(seed, i)
    name = F.concat(d.of("first", _FIRST), F.lit(" "), d.of("last", _LAST))
    dob = F.format_string("%02d/%02d/%d", d.between("day", 1, 28), d.between("month", 1, 12), d.between("year", 1935, 2010))
    mrn = F.format_string("MRN-%d", d.between("mrn", 100_000, 999_999))
    medicare = medicare_number(F.concat(d.between("m0", 2, 6).cast("string"), F.lpad(d.below("m", 10_000_000).cast("string"), 7, "0")))
    phone = F.format_string("04%d %d %d", d.between("f1", 10, 99), d.between("f2", 100, 999), d.between("f3", 100, 999))
    address = F.format_string("%d %s, %s NSW %d", d.between("no", 1, 999), d.of("street", _STREETS), d.of("suburb", _SUBURBS), d.between("code", 2000, 2999))
    k = i % len(_NOTES)
    text, template = F.lit(None).cast("string"), F.lit(None).cast("string")
    for j, (title, body) in enumerate(_NOTES):
        text = F.when(k == j, F.format_string(body, name, dob, mrn, medicare, phone, address)).otherwise(text)
        template = F.when(k == j, title).otherwise(template)
    labels = F.array(_label("name", name), _label("date_of_birth", dob), _label("medical_record_number", mrn), _label("medicare", medicare), _label("phone", phone), _label("address", address))
    return spark.range(n).select(F.format_string("medical-%06d", i).alias("id"), text.alias("text"), template.alias("template"), labels.alias("labels"))
