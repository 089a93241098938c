"""Text, identifier and address normalisation as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of true in text flags.
TRUE_WORDS = ("true", "1", "ja", "yes")
#: Texts that stand for a missing value.
MISSING_WORDS = ("nan", "none", "<na>")
#: Street abbreviations by whole word, and the province's own words.
STREET_WORDS = {"burg": "burgemeester", "burg.": "burgemeester", "str": "straat", "str.": "straat", "wg": "weg", "wg.": "weg", "ln": "laan", "ln.": "laan"}
STREET_VARIANTS = {"strjitte": "straat"}
#: Initials, and particles.
STREET_INITIALS = {"b": "bartholomeus", "j": "johan", "w": "willem"}
STREET_PARTICLES = {"vd": "van der", "v": "van"}
#: Street endings, attached to a word of at least two more letters.
STREET_ENDINGS = {"strjitte": "straat", "straat": "straat", "str": "straat", "wg": "weg", "ln": "laan"}


def _lookup(words: dict[str, str], word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), word)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column with text in it."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def plain(c: Column) -> Column:
    """Null as empty, trimmed, lower case."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def squeezed(c: Column) -> Column:
    """``plain`` with runs of space as one space."""
    return F.regexp_replace(plain(c), r"\s+", " ")


def text_flag(c: Column) -> Column:
    """Text booleans: true, 1, ja and yes are true, everything else and null is false."""
    return plain(c).isin(*TRUE_WORDS)


def yes_no(c: Column) -> Column:
    """J/N flags in capitals without space; null stays null."""
    return F.upper(F.trim(c.cast("string")))


def shown_yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "Ja").otherwise("Nee")


def padded(c: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer texts stay whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def municipality_code(c: Column, digits_only: bool = False) -> Column:
    """Trimmed, without a leading GM, four digits; with ``digits_only`` null where other characters stand."""
    code = padded(F.regexp_replace(F.upper(F.trim(c.cast("string"))), "^GM", ""), 4)
    return F.when(code.rlike("^[0-9]+$"), code) if digits_only else code


def plain_id(c: Column, width: int | None = None) -> Column:
    """Identifiers as text without the ``.0`` that spreadsheets add; padded with zeros if a width is given."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return padded(text, width) if width else text


def without_accents(c: Column) -> Column:
    """Latin letters without their accents: letters that decompose into a base letter and marks."""
    source, target = _accents()
    return F.translate(c, source, target)


def _accents() -> tuple[str, str]:
    import unicodedata

    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code) and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def comparable(c: Column) -> Column:
    """Free text to compare: lower case, no accents, hyphens, dots and quotes as spaces, single spaces."""
    bare = F.regexp_replace(without_accents(plain(c)), r"[̀-ͯ]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[-.'’]", " "), r"\s+", " ")


def street(c: Column) -> Column:
    """Street names to compare: abbreviations, attached endings, initials and particles written out, ij as y."""

    def word(w: Column) -> Column:
        w = _lookup(STREET_VARIANTS, _lookup(STREET_WORDS, w))
        ending = w  # the longest ending is asked last, so it is decided first
        for end, full in sorted(STREET_ENDINGS.items(), key=lambda e: len(e[0])):
            ending = F.when((F.length(w) > len(end) + 1) & w.endswith(end), F.concat(F.left(w, F.length(w) - len(end)), F.lit(full))).otherwise(ending)
        return _lookup(STREET_PARTICLES, _lookup(STREET_INITIALS, ending))

    words = F.filter(F.split(comparable(c), " "), lambda w: w != "")
    return F.replace(F.array_join(F.transform(words, word), " "), F.lit("ij"), F.lit("y"))


def postcode(c: Column) -> Column:
    """Capitals without any space; null as empty."""
    return F.regexp_replace(F.upper(F.coalesce(c.cast("string"), F.lit(""))), r"\s+", "")


def house_number(c: Column) -> Column:
    """struct(number, letter, addition) of a written house number; other texts are the number as they are."""
    pattern, text = r"^(\d+)\s*[-/]?\s*([A-Za-z]?)\s*[-/]?\s*(.*)$", F.trim(F.coalesce(c.cast("string"), F.lit("")))
    hit = text.rlike(pattern)
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.struct(
        F.when(hit, part(1)).otherwise(comparable(c)).alias("number"),
        F.when(hit, F.upper(part(2))).otherwise("").alias("letter"),
        F.when(hit, comparable(part(3))).otherwise("").alias("addition"),
    )


def written_house_number(number: Column, letter: Column, addition: Column, combined: Column) -> Column:
    """Number, letter and addition in one text; the combined column where they are empty."""
    own = F.trim(F.concat_ws(" ", blank_to_null(number), blank_to_null(letter), blank_to_null(addition)))
    return F.regexp_replace(F.coalesce(F.nullif(own, F.lit("")), F.trim(combined), F.lit("")), r"\s+", " ")


def address_keys(street_c: Column, number_c: Column, postcode_c: Column, town_c: Column) -> Column:
    """struct(exact, basic, town) of keys: all parts; postcode and number; town, street and number."""
    n, s, p, t = house_number(number_c), street(street_c), postcode(postcode_c), comparable(town_c)
    full = [n["number"], n["letter"], n["addition"]]
    return F.struct(F.concat_ws("|", p, *full, s).alias("exact"), F.concat_ws("|", p, *full).alias("basic"), F.concat_ws("|", t, s, *full).alias("town"))


def first_number(c: Column) -> Column:
    """The first run of digits as a number, else null."""
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).try_cast("bigint")


def decimal_number(c: Column) -> Column:
    """The first number in a text, with a comma or point before its decimals, else null."""
    return F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit(".")), r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def simple_words(c: Column) -> Column:
    """Lower case letters and digits with single spaces between; the province's own spelling as the Dutch one."""
    text = F.replace(plain(c), F.lit("fryslân"), F.lit("friesland"))
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def line_number(c: Column) -> Column:
    """Line codes to compare: capitals, numbers without leading zeros, missing words as empty."""
    text = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(F.lower(text).isin(*MISSING_WORDS), "").when(text.rlike("^[0-9]+$"), text.try_cast("bigint").cast("string")).otherwise(text)


def vehicle_mode(c: Column) -> Column:
    """bus, train, ferry or unknown by the words of a vehicle description."""
    text = simple_words(c)
    return F.when(text.contains("bus"), "bus").when(text.contains("trein"), "train").when(text.rlike("veer|boot|ferry"), "ferry").otherwise("unknown")


def text_set(c: Column, separator: str = ", ") -> Column:
    """Aggregate: the distinct texts of a group, sorted and joined, without empty and missing ones."""
    text = blank_to_null(c)
    return F.array_join(F.array_sort(F.collect_set(F.when(~F.lower(text).isin(*MISSING_WORDS), text))), separator)


def list_text(c: Column) -> Column:
    """Lower-case array of a tag that is one word or a written list of quoted words."""
    text = F.lower(F.trim(c.cast("string")))
    inner = F.regexp_replace(F.regexp_replace(text, r"^\[|\]$", ""), r"['\"]", "")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.rlike(r"^\[.*\]$"), F.filter(F.transform(F.split(inner, ","), lambda t: F.trim(t)), lambda w: w != "")).otherwise(F.array(text))


def contains_any(c: Column, words) -> Column:
    """Whether a text holds one of the words anywhere."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def address_line(*parts: Column) -> Column:
    """The filled parts with single spaces between, null if none is."""
    return blank_to_null(F.concat_ws(" ", *[blank_to_null(p) for p in parts]))


def to_text(c: Column, lower: bool = False) -> Column:
    """Text of any value: whole floats without ``.0``, empty as null."""
    text = blank_to_null(F.regexp_replace(c.cast("string"), r"\.0$", ""))
    return F.lower(text) if lower else text
