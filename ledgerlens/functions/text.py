"""Text folds, spans, names, addresses and table cells, as column expressions.

All take and return columns and stay inside code generation; ``similarity`` holds what needs Python.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAME_LABELS = ("patient", "name", "last", "first", "middle", "initial", "insured")
STATE_ZIP = r"^(.*?)[,\s]+([A-Z]{2})\s+(\d{5})(?:-?(\d{4}))?$"
#: Readings of signs that OCR takes for digits, and of letters for each other.
NUMERIC_GLYPHS = ("OoQDIlL|SsBZz", "0000111155822")


def collapse_spaces(x: Column) -> Column:
    """White space runs as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def compact_upper(x: Column) -> Column:
    """Upper case without white space: codes."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"\s+", "")


def identifier(x: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def label_fold(x: Column) -> Column:
    """Lower case, ``|`` read as i, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), "|", "i"), "[^a-z0-9]+", " "))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def word_set(x: Column) -> Column:
    """The distinct folded words, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.split(label_fold(x), " "), lambda w: w != "")))


def substitute_tokens(x: Column, readings: dict[str, str]) -> Column:
    """Folded tokens with known misreadings replaced."""
    table = F.create_map(*[F.lit(v) for pair in readings.items() for v in pair])
    return F.transform(F.split(label_fold(x), " "), lambda t: F.coalesce(table[t], t))


def contains_tokens(text: Column, phrase: Column) -> Column:
    """Whether the phrase's folded tokens follow each other in the text's."""
    return F.concat(F.lit(" "), label_fold(text), F.lit(" ")).contains(F.concat(F.lit(" "), label_fold(phrase), F.lit(" ")))


def label_firewall(value: Column, labels: Column) -> Column:
    """True if the folded value neither is a label nor lies inside one."""
    folded = label_fold(value)
    return ~F.exists(labels, lambda label: (label_fold(label) == folded) | label_fold(label).contains(folded))


def currency(x: Column) -> Column:
    """An amount of two decimals, half to even: bars dropped, parentheses negative; null if there is none."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), r"\|", "")
    negative = F.trim(bare).rlike(r"^\(.*\)$")
    number = F.regexp_replace(bare, "[^0-9.-]", "").try_cast("decimal(20,6)")
    return F.bround(F.when(negative, -F.abs(number)).otherwise(number), 2).cast("decimal(18,2)")


def checkbox(x: Column) -> Column:
    """True, false or null for a mark; an empty box is false."""
    mark = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(mark.isin("X", "[X]", "YES"), True).when(mark.isin("", "[ ]", "NO"), False)


def numeric_glyphs(x: Column) -> Column:
    """Letters that OCR confuses with digits, as digits."""
    return F.translate(F.coalesce(x, F.lit("")), *NUMERIC_GLYPHS)


def person_name(x: Column, last_first: bool = False) -> Column:
    """last, first, middle of a name; a comma always puts the last name first."""
    text = F.upper(collapse_spaces(x))
    comma = F.split(text, r"\s*,\s*")
    words = F.split(text, " ")
    rest = F.split(F.get(comma, F.lit(1)), " ")
    n = F.size(words)
    by_comma = F.struct(F.get(comma, F.lit(0)).alias("last"), F.get(rest, F.lit(0)).alias("first"), F.array_join(F.slice(rest, 2, 9), " ").alias("middle"))
    first_at, last_at = (2, 1) if last_first else (1, -1)
    plain = F.struct(
        F.when(n > 0, F.element_at(words, last_at)).alias("last"),
        F.when(n > 1, F.try_element_at(words, F.lit(first_at))).alias("first"),
        F.when(n > 2, F.array_join(F.slice(words, 3 if last_first else 2, n - 2), " ")).otherwise("").alias("middle"),
    )
    return F.when(text.contains(","), by_comma).otherwise(plain)


def label_contaminated(x: Column, labels: tuple = NAME_LABELS) -> Column:
    """Whether a name holds a form label's word."""
    return F.upper(F.coalesce(x, F.lit(""))).rlike(r"\b(" + "|".join(labels).upper() + r")\b")


def tokens_contaminated(value: Column, label: Column) -> Column:
    """Whether value and label share all of the label's words but one."""
    a, b = word_set(value), word_set(label)
    return F.size(F.array_intersect(a, b)) >= F.greatest(F.lit(1), F.size(b) - 1)


def name_key(x: Column) -> Column:
    """A key under which spellings of a name agree: ASCII letters, surname moved behind a comma's first name."""
    text = F.upper(collapse_spaces(x))
    swapped = F.regexp_replace(text, r"^([^,]+),\s*(.+)$", "$2 $1")
    return collapse_spaces(F.regexp_replace(F.regexp_replace(swapped, r"['.]", ""), "[^A-Z ]", " "))


def names_agree(a: Column, b: Column) -> Column:
    return (name_key(a) == name_key(b)) & (name_key(a) != "") & ~label_contaminated(a) & ~label_contaminated(b)


def address(lines: Column) -> Column:
    """line1, line2, city, state, zip of address lines; the last line holds city, state and zip."""
    last = F.upper(collapse_spaces(F.try_element_at(lines, F.lit(-1))))
    part = lambda k: F.nullif(F.regexp_extract(last, STATE_ZIP, k), F.lit(""))
    n = F.size(lines)
    return F.struct(
        F.when(n > 1, collapse_spaces(F.element_at(lines, 1))).alias("line1"),
        F.when(n > 2, collapse_spaces(F.try_element_at(lines, F.lit(2)))).alias("line2"),
        part(1).alias("city"),
        part(2).alias("state"),
        part(3).alias("zip"),
    )


def repair_house_number(x: Column) -> Column:
    """O and I at the start of an address read as digits where a digit follows or precedes them."""
    text = collapse_spaces(x)
    return F.regexp_replace(F.regexp_replace(text, r"^[Oo](?=\d)", "0"), r"^[Il](?=\d)", "1")


def po_box(x: Column) -> Column:
    """The number of a post-office box, else null."""
    return F.nullif(F.regexp_extract(F.upper(F.coalesce(x, F.lit(""))), r"\bP\.?\s*O\.?\s*BOX\s*([0-9]+)", 1), F.lit(""))


#: Name suffixes, words of address labels, ends of street names, and engines by family, the first that a name holds.
NAME_SUFFIXES = ("JR", "SR", "II", "III", "IV")
ADDRESS_LABELS = r"\b(PATIENT|ADDRESS|CITY|STATE|ZIP|INSURED)\b"
ENGINE_FAMILIES = (
    ("rapidocr", "RAPIDOCR_FAMILY"), ("paddle", "PADDLE_FAMILY"), ("pp-ocr", "PADDLE_FAMILY"), ("tesseract", "TESSERACT_FAMILY"), ("gemini", "GEMINI_FAMILY"), ("textract", "TEXTRACT_FAMILY"),
    ("trocr", "TROCR_FAMILY"), ("florence", "FLORENCE_FAMILY"), ("got-ocr", "GOT_OCR_FAMILY"), ("got_ocr", "GOT_OCR_FAMILY"), ("azure", "AZURE_READ_FAMILY"),
)


def engine_family(engine: Column) -> Column:
    """The family of an engine's name; a name of no family is its own."""
    name = F.lower(engine)
    return F.coalesce(*[F.when(name.contains(part), F.lit(family)) for part, family in ENGINE_FAMILIES], F.upper(engine))


def canonical_name(name: Column, aliases: dict[str, str]) -> Column:
    """The field that a name stands for; other names stand for themselves."""
    if not aliases:
        return name
    return F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[name], name)


def name_interpretations(x: Column, convention: str | None = None) -> Column:
    """The distinct ways to read a complete name, as structs (first, middle, last, suffix, convention), those of a convention first.

    A comma puts the last name before it; without one, and besides, the name is read in both orders.
    """
    text = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ ,.]+|[ ,.]+$", "")
    kind = lambda first, middle, last, suffix, how: F.struct(first.alias("first"), middle.alias("middle"), last.alias("last"), suffix.alias("suffix"), F.lit(how).alias("convention"))
    tokens = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    joined = lambda a: F.array_join(a, " ")
    rest = tokens(F.trim(F.regexp_extract(text, r"^[^,]*,(.*)$", 1)))
    final = F.regexp_replace(F.upper(F.get(rest, F.size(rest) - 1)), r"\.+$", "")
    suffix = F.when(final.isin(*NAME_SUFFIXES), final).otherwise("")
    given = F.when(suffix != "", F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0)))).otherwise(rest)
    every = tokens(F.replace(text, F.lit(","), F.lit("")))
    n, blank = F.size(every), F.lit("")
    ways = [
        F.when(text.contains(",") & (F.size(given) > 0), kind(F.get(given, F.lit(0)), joined(F.slice(given, 2, F.size(given))), F.trim(F.regexp_extract(text, "^([^,]*),", 1)), suffix, "LAST_FIRST")),
        F.when(n >= 2, kind(F.get(every, F.lit(0)), joined(F.slice(every, 2, F.greatest(n - 2, F.lit(0)))), F.get(every, n - 1), blank, "FIRST_LAST")),
        F.when(n >= 2, kind(F.get(every, F.lit(1)), joined(F.slice(every, 3, n)), F.get(every, F.lit(0)), blank, "LAST_FIRST")),
    ]
    found = F.array_distinct(F.filter(F.array(*ways), lambda w: w.isNotNull()))
    if convention:
        found = F.concat(F.filter(found, lambda w: w["convention"] == convention), F.filter(found, lambda w: w["convention"] != convention))
    return found


def clean_city(x: Column) -> Column:
    """A city's name in upper case, without other signs; null if nothing is left, or a label."""
    city = F.upper(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z .'-]", " "), r"^[ .'-]+|[ .'-]+$", ""), r"\s+", " ")))
    return F.when(city.rlike(r"^[A-Z][A-Z .'-]+$") & ~city.rlike(ADDRESS_LABELS), city)


def clean_secondary_name(x: Column, split_md: bool = True) -> Column:
    """A second name without an initial that the next word repeats; MD at the end is a word of its own."""
    text = F.upper(F.regexp_replace(x, "[.:'\u00b7\uff1a\ufffd]+", " "))
    if split_md:
        text = F.regexp_replace(text, r"(?<=[A-Z])MD$", " MD")
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    kept = F.filter(F.transform(parts, lambda w, i: F.when((F.length(w) == 1) & F.coalesce(F.startswith(F.get(parts, i + 1), w), F.lit(False)), F.lit(None)).otherwise(w)), lambda w: w.isNotNull())
    return F.array_join(kept, " ")


def box_with_zip(address: Column, postal: Column) -> Column:
    """A PO box whose number has a misread sign, completed from the last four digits of a nine-digit code; else the address.

    The digits before the sign stay; the code's last four follow, less what they repeat of those digits' end.
    """
    digits_ = F.regexp_replace(F.coalesce(postal, F.lit("")), r"\D", "")
    number = F.regexp_extract(F.upper(address), r"^\s*PO\s+BOX\s+([0-9OBISL/]+)\s*$", 1)
    head = F.regexp_extract(number, r"^\d+", 0)
    tail = F.substring(digits_, 6, 4)
    repeated = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.when((k <= F.length(head)) & (F.right(head, k) == F.left(tail, k)), k).otherwise(0)))
    usable = (F.length(digits_) == 9) & number.rlike("[OBISL/]") & (head != "")
    return F.when(F.coalesce(usable, F.lit(False)), F.concat(F.lit("PO BOX "), head, F.substring(tail, repeated + 1, F.lit(4)))).otherwise(address)


def zone_score(x0: Column, y0: Column, x1: Column, y1: Column, zone: tuple, width: Column, height: Column, tolerance: float = 0.08) -> Column:
    """1 where a box's centre, as shares of the page, lies in a zone, 0.65 within the tolerance of it, else 0."""
    cx, cy = (x0 + x1) / 2 / F.greatest(width, F.lit(1)), (y0 + y1) / 2 / F.greatest(height, F.lit(1))
    within = lambda t: cx.between(zone[0] - t, zone[2] + t) & cy.between(zone[1] - t, zone[3] + t)
    return F.when(within(0.0), 1.0).when(within(tolerance), 0.65).otherwise(0.0)


def agreement_key(field: Column, value: Column) -> Column:
    """The form in which two readings of a field are compared; amounts keep their point, so 10.00 isn't 1000."""
    name = F.lower(field)
    amount = F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9.-]", "").try_cast("decimal(20,6)").cast("string")
    short = F.regexp_replace(F.regexp_replace(amount, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (
        F.when(name.rlike("charge|amount|price|total"), F.coalesce(short, F.lit("")))
        .when(name.rlike("date|dob"), digits(value))
        .when(name.rlike("npi|zip|phone|tax"), digits(value))
        .when(name.rlike("name"), name_key(value))
        .otherwise(identifier(value))
    )


#: Patterns of the span types, and whether the last match is preferred.
SPANS = {
    "date": (r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}", False),
    "amount": (r"-?\d+(?:\.\d{2})?", True),
    "npi": (r"(?<!\d)\d{10}(?!\d)", False),
    "zip": (r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)", True),
    "code": (r"[A-Z][0-9]{2}(?:\.[0-9A-Z]{1,4})?", False),
}


def select_span(x: Column, kind: str) -> Column:
    """value, count and reason of the span of a type in a text; several spans give the preferred end's and a reason."""
    pattern, last = SPANS[kind]
    found = F.regexp_extract_all(F.upper(F.coalesce(x, F.lit(""))), F.lit(pattern), F.lit(0))
    n = F.size(found)
    reason = F.when(n == 0, "NO_SPAN").when(n == 1, "SINGLE_SPAN").otherwise("LAST_SPAN" if last else "FIRST_SPAN")
    return F.struct(F.try_element_at(found, F.lit(-1 if last else 1)).alias("value"), n.alias("n"), reason.alias("reason"))


def glyph_alternatives(x: Column, swaps: dict[str, str]) -> Column:
    """The texts that differ from x in one confused glyph."""
    chars = F.split(x, "")
    table = F.create_map(*[F.lit(v) for pair in swaps.items() for v in pair])
    one = lambda c, k: F.when(table[c].isNotNull(), F.concat(F.substring(x, F.lit(1), k), table[c], F.substring(x, k + 2, F.lit(9999))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(chars, one), lambda v: v.isNotNull())))


def redact(properties: Column, markers: tuple = ("name", "ssn", "dob", "email", "phone", "address", "member")) -> Column:
    """A flat JSON object's map with the values of sensitive keys replaced."""
    hit = lambda k: F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.lower(k).contains(m))
    return F.transform_values(F.from_json(properties, "map<string,string>"), lambda k, v: F.when(hit(k), F.lit("[REDACTED]")).otherwise(v))


def cell(x: Column, column: Column) -> Column:
    """value, rule and ok of a table cell by its column's type."""
    amount = currency(numeric_glyphs(x)).cast("string")
    units = F.nullif(F.regexp_extract(numeric_glyphs(F.trim(x)), r"^(\d+)(?:\.0+)?$", 1), F.lit(""))
    code = F.nullif(F.regexp_extract(compact_upper(x), "^[A-Z0-9]{5}$", 0), F.lit(""))
    value = F.when(column.isin("charge", "amount"), amount).when(column == "units", units).when(column == "code", code).otherwise(collapse_spaces(x))
    return F.struct(value.alias("value"), F.coalesce(column, F.lit("text")).alias("rule"), (F.coalesce(value, F.lit("")) != "").alias("ok"))


def error_rate(expected: Column, actual: Column) -> Column:
    """Edit distance over the expected length; an empty expectation gives 0 or 1."""
    e, a = F.coalesce(expected, F.lit("")), F.coalesce(actual, F.lit(""))
    return F.when(e == "", F.when(a == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(e, a) / F.length(e))
