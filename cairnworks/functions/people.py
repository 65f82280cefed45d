"""Names of persons in both orders, and keys of street addresses, as Column expressions; null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnworks.functions.names import _let, _words

# The vocabularies and limits that results depend on.
BUSINESS_TOKENS = (
    "LLC", "INC", "CORP", "CORPORATION", "CO", "COMPANY", "PLLC", "LTD", "LP", "LLP", "PS", "PC", "GROUP", "SERVICE", "SERVICES", "SVC", "SVCS", "CONSTRUCTION",
    "CONTRACTING", "CONTRACTOR", "CONTRACTORS", "PLUMBING", "ELECTRIC", "ELECTRICAL", "HEATING", "COOLING", "ROOFING", "HVAC", "MECHANICAL", "BUILDER", "BUILDERS",
    "BUILDING", "DEVELOPMENT", "DEVELOPERS", "ENTERPRISE", "ENTERPRISES", "HOLDING", "HOLDINGS", "PROPERTIES", "PROPERTY", "ASSOCIATES", "PARTNERS", "PARTNERSHIP",
    "SOLUTIONS", "SYSTEMS", "INDUSTRIES", "CONCRETE", "PAINTING", "LANDSCAPING", "REMODELING", "REMODEL", "HOMES", "HOME", "TRUST", "BANK", "CHURCH", "CITY",
    "COUNTY", "SCHOOL", "DISTRICT", "AND", "THE", "OF", "DBA", "ESTATE", "FAMILY", "REVOCABLE", "LIVING", "INVESTMENTS", "MANAGEMENT", "CONSULTING", "DESIGN",
    "SUPPLY", "METAL", "SIGNS", "SOLAR", "STEEL", "POOLS", "SURVEYING", "WAREHOUSE", "RESTORATION", "RECREATION", "ENERGY", "WATER", "SHEET", "CLEANING",
)
GENERATIONS = ("JR", "SR", "II", "III", "IV")
ADDRESS_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "ROAD": "RD", "BOULEVARD": "BLVD", "DRIVE": "DR", "LANE": "LN", "COURT": "CT", "PLACE": "PL", "CIRCLE": "CIR", "TERRACE": "TER",
    "HIGHWAY": "HWY", "PARKWAY": "PKWY", "TRAIL": "TRL", "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
}
UNIT_DESIGNATORS = ("UNIT", "STE", "SUITE", "APT", "APARTMENT", "BLDG", "BUILDING", "FL", "FLOOR", "RM", "ROOM", "SPACE", "SPC")
NO_ADDRESS = r"(?i)^\s*(?:NONE|N/?A|UNKNOWN|SAME|TBD|NULL)\b"
STREET_TAILS = (*ADDRESS_WORDS.values(), "WAY", "LOOP")
MAX_CITY_WORDS, MIN_WORDS, MIN_LENGTH = 3, 3, 8


def clean_name(raw: Column) -> Column:
    """Capitals, commas and single spaces; everything else goes without a gap."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(raw), "[^A-Z, ]", ""), r"\s+", " "))


def person_parts(raw: Column) -> Column:
    """struct(surname, given, middle) of 'Last, First M' or 'First M Last'; null unless two or three words, none of them of a business."""

    def judge(n: Column) -> Column:
        comma = F.instr(n, ",")
        before = F.when(comma > 0, F.trim(F.substring_index(n, ",", 1))).otherwise("")
        after = F.when(comma > 0, F.replace(F.substr(n, comma + 1), F.lit(","), F.lit(" "))).otherwise(n)
        split = F.struct(_words(before).alias("b"), _words(after).alias("a"), (comma > 0).alias("comma"))

        def read(s: Column) -> Column:
            real = lambda words: F.filter(words, lambda w: ~w.isin(*GENERATIONS))
            every = F.concat(s["b"], s["a"])
            person = ~F.exists(every, lambda w: w.isin(*BUSINESS_TOKENS)) & F.size(real(every)).between(2, 3)
            b, a = real(s["b"]), real(s["a"])
            listed = F.when((F.size(b) > 0) & (F.size(a) > 0), F.struct(F.get(b, F.lit(0)).alias("surname"), F.get(a, F.lit(0)).alias("given"), F.substring(F.get(a, F.lit(1)), 1, 1).alias("middle")))
            plain = F.struct(F.element_at(a, -1).alias("surname"), F.get(a, F.lit(0)).alias("given"), F.when(F.size(a) == 3, F.substring(F.get(a, F.lit(1)), 1, 1)).alias("middle"))
            return F.when(person, F.when(s["comma"], listed).otherwise(plain))

        return _let(split, read)

    return F.when(F.length(clean_name(raw)) > 0, _let(clean_name(raw), judge))


def person_core_key(raw: Column) -> Column:
    """'SURNAME|GIVEN' of a person's name in either order."""
    return _let(person_parts(raw), lambda p: F.concat(p["surname"], F.lit("|"), p["given"]))


def full_principal_key(raw: Column) -> Column:
    """A registry's 'SURNAME, GIVEN M', cleaned; null without a comma, as for agents and firms."""
    return _let(clean_name(raw), lambda k: F.when(k.contains(","), k))


def core_of_principal(raw: Column) -> Column:
    """'SURNAME|GIVEN' of a registry's key."""

    def cut(k: Column) -> Column:
        surname, given = F.trim(F.substring_index(k, ",", 1)), F.substring_index(F.trim(F.substr(k, F.instr(k, ",") + 1)), " ", 1)
        return F.when(k.contains(",") & (surname != "") & (given != ""), F.concat(surname, F.lit("|"), given))

    return _let(clean_name(raw), cut)


def key_initial(key: Column) -> Column:
    """The middle initial of a registry's key; null without a comma."""
    given = _words(F.trim(F.substr(key, F.instr(key, ",") + 1)))
    return F.when(key.contains(","), F.upper(F.substring(F.get(given, F.lit(1)), 1, 1)))


def _unit_value(word: Column) -> Column:
    return F.coalesce((word.rlike(r"\d") & (F.length(word) <= 6)) | (F.length(word) == 1), F.lit(False))


def street_key(raw: Column) -> Column:
    """An address in standard words without unit designators and their values; null under three words, without a digit or too short."""
    short = F.create_map(*(F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair))
    words = F.transform(_words(F.regexp_replace(F.replace(F.upper(raw), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " ")), lambda w: F.coalesce(F.element_at(short, w), w))

    def without_units(words: Column) -> Column:
        # A value goes only if the designator before it was read as one, and was no value itself.
        state = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("after"))

        def step(s: Column, w: Column) -> Column:
            value = s["after"] & _unit_value(w)
            unit = ~value & w.isin(*UNIT_DESIGNATORS)
            return F.struct(F.when(value | unit, s["out"]).otherwise(F.array_append(s["out"], w)).alias("out"), unit.alias("after"))

        return F.aggregate(words, state, step, lambda s: s["out"])

    def judge(out: Column) -> Column:
        return _let(F.array_join(out, " "), lambda key: F.when((F.size(out) >= MIN_WORDS) & key.rlike(r"\d") & (F.length(key) >= MIN_LENGTH), key))

    return F.when(raw.isNotNull(), _let(_let(words, without_units), judge))


def zip_key(raw: Column, zip_code: Column) -> Column:
    """'STREET KEY ZIP5': the street before the first comma, the ZIP as given or else the last one in the text; null for placeholders."""
    stated = F.nullif(F.regexp_extract(F.coalesce(zip_code, F.lit("")), r"\b(\d{5})(?:-\d{4})?\b", 1), F.lit(""))
    inline = F.substring(F.element_at(F.regexp_extract_all(raw, F.lit(r"\b\d{5}(?:-\d{4})?\b"), F.lit(0)), -1), 1, 5)
    street = F.when(raw.contains(","), F.substring_index(raw, ",", 1)).otherwise(F.regexp_replace(raw, r"\s+[A-Za-z]{2}\s+\d{5}(?:-\d{4})?\s*$", ""))
    found = F.coalesce(stated, F.when(F.size(F.regexp_extract_all(raw, F.lit(r"\b\d{5}(?:-\d{4})?\b"), F.lit(0))) > 0, inline))
    return F.when(~raw.rlike(NO_ADDRESS), F.concat(street_key(street), F.lit(" "), found))


def key_ladder(raw: Column, zip_code: Column) -> Column:
    """Candidate keys of an address, best first: its own; without up to three trailing words that may be a city (if it has no comma);
    and each of these without a trailing unit number. An empty array for no key."""

    def ladder(primary: Column) -> Column:
        words = _words(primary)
        street, code = F.slice(words, 1, F.size(words) - 1), F.element_at(words, -1)

        def climb(p: Column) -> Column:
            n = F.size(p["street"])

            # Peeling k words is possible if each of them may be a city's and what is left still is a street.
            def possible(k: Column) -> Column:
                gone = F.get(p["street"], n - k)
                left = F.slice(p["street"], F.lit(1), F.greatest(n - k, F.lit(0)))
                text = F.array_join(left, " ")
                return ~gone.rlike(r"\d") & ~gone.isin(*STREET_TAILS) & (n - k >= MIN_WORDS) & text.rlike(r"\d") & (F.length(text) >= MIN_LENGTH)

            steps = F.filter(F.array(*map(F.lit, range(1, MAX_CITY_WORDS + 1))), lambda k: F.coalesce((n - k >= MIN_WORDS) & possible(k), F.lit(False)))
            whole = F.filter(steps, lambda k: F.size(F.filter(steps, lambda j: j <= k)) == k)  # the first that fails ends the ladder
            cuts = F.when(p["comma"], F.array(F.lit(0))).otherwise(F.concat(F.array(F.lit(0)), whole))
            streets = F.transform(cuts, lambda k: F.slice(p["street"], F.lit(1), n - k))

            def without_unit(s: Column) -> Column:
                left = F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
                text = F.array_join(left, " ")
                fits = _unit_value(F.element_at(s, -1)) & F.get(s, F.size(s) - 2).isin(*STREET_TAILS) & (F.size(left) >= MIN_WORDS) & text.rlike(r"\d") & (F.length(text) >= MIN_LENGTH)
                return F.when(F.coalesce(fits, F.lit(False)), text)

            texts = F.concat(F.transform(streets, lambda s: F.array_join(s, " ")), F.array_compact(F.transform(streets, without_unit)))
            return F.array_distinct(F.transform(texts, lambda s: F.concat(s, F.lit(" "), p["zip"])))

        return _let(F.struct(street.alias("street"), code.alias("zip"), raw.contains(",").alias("comma")), climb)

    return F.coalesce(_let(zip_key(raw, zip_code), lambda k: F.when(k.isNotNull(), ladder(k))), F.array().cast("array<string>"))
