"""Column expressions for names, quotes, ids and hosts. The normalisers differ on purpose and are never shared."""

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NAME_STOPWORDS = ("el", "la", "los", "las", "de", "del", "un", "una", "y", "en", "a", "proyecto", "edificio")
GENERIC_NAMES = ("data center", "vespucio", "ciudad empresarial", "lo aguirre", "las americas", "supermercado lider")

#: Characters that the compatibility decomposition may change: the basic plane without Korean syllables, mathematical and enclosed letters.
_PLACES = (*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200))
#: What str.strip and str.split take for white space.
BLANK = r"[\s\x{1c}-\x{1f}]"


@cache
def _ascii_of() -> dict[str, str]:
    """The ASCII rest of each decomposition that has one."""
    made = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, _PLACES)}
    return {c: a for c, a in made.items() if a}


@cache
def _unmarked() -> dict[str, str]:
    """Each decomposition without its combining marks, where that is another string."""
    made = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in map(chr, _PLACES)}
    return {c: a for c, a in made.items() if a != c}


def _replaced(text: Column, table: dict[str, str]) -> Column:
    """Characters by the table: single ones by translate; the few longer ones by a look-up, only in strings that are not plain after it."""
    one = {c: a for c, a in table.items() if len(a) == 1}
    # translate deletes characters that have no partner, so they stand last
    none = [c for c, a in table.items() if not a]
    several = {c: a for c, a in table.items() if len(a) > 1}
    plain = F.translate(text, "".join([*one, *none]), "".join(one.values()))
    longer = F.str_to_map(F.lit("\x02".join(f"{c}\x01{a}" for c, a in several.items())), F.lit("\x02"), F.lit("\x01"))
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.coalesce(longer[c], c)).otherwise(c)), "")
    return F.when(plain.rlike(r"[^\x00-\x7F]"), spelled).otherwise(plain)


def fold_ascii(text: Column) -> Column:
    """Compatibility-decompose, drop what isn't ASCII, lower case."""
    return F.lower(F.regexp_replace(_replaced(text, _ascii_of()), r"[^\x00-\x7F]", ""))


def strip_marks(text: Column) -> Column:
    """Compatibility-decompose and drop combining marks only; other characters stay."""
    return _replaced(text, _unmarked())


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def norm_key(text: Column) -> Column:
    """Folded, lower case, single spaces."""
    return collapse(fold_ascii(F.coalesce(text, F.lit(""))))


def norm_plain(text: Column) -> Column:
    """Lower case and single spaces; accents stay. Quotes and actors' names are compared so."""
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def norm_geo(text: Column) -> Column:
    """Lower case without combining marks, hyphens as spaces; other characters stay."""
    return collapse(F.replace(strip_marks(F.lower(F.coalesce(text, F.lit("")))), F.lit("-"), F.lit(" ")))


def norm_name(text: Column) -> Column:
    """Project names: folded; a letter that a hyphen ties to a number is part of it; punctuation as spaces; stop words out."""
    folded = fold_ascii(F.coalesce(text, F.lit("")))
    # a single letter after digit and hyphen, whatever follows it but another letter
    tied = F.regexp_replace(folded, "([0-9])-([a-z])(?=[^a-z]|$)", "$1$2")
    words = F.split(F.regexp_replace(tied, "[^a-z0-9_]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*NAME_STOPWORDS)), " ")


def stable_id(*parts: Column | str, sep: str = "|", n: int = 24) -> Column:
    """The first digits of the SHA-256 of the joined parts."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.concat_ws(sep, *columns), 256), 1, n)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def stage_tokens(name: Column) -> Column:
    """Sorted set of a name's stage labels: 'etapa' or 'fase' and its number, Roman or not, joined by an underscore."""
    # other signs than white space keep a label and its number apart
    words = F.split(F.regexp_replace(F.regexp_replace(fold_ascii(name), rf"([^a-z0-9_\s\x{{1c}}-\x{{1f}}])", " $1 "), rf"{BLANK}+", " "), " ")
    follows = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda w, n: F.struct(w.alias("w"), n.alias("n")))
    labels = F.filter(follows, lambda x: x["w"].isin("etapa", "fase") & F.coalesce(x["n"].rlike("^[ivx0-9]+$"), F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.concat_ws("_", x["w"], x["n"]))))


def trailing_numeral(name: Column) -> Column:
    """A name's last word where it is a number or one of the Roman ones up to four, else an empty string."""
    last = F.element_at(F.split(F.regexp_replace(strip(fold_ascii(name)), r"[^a-z0-9_]", " "), " "), -1)
    return F.when(last.isin("i", "ii", "iii", "iv") | last.rlike("^[0-9]+$"), last).otherwise("")


def split_compound(text: Column) -> Column:
    """Names joined by 'y', 'e', ';', ',' or '/'."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?iU){BLANK}+[ye]{BLANK}+", ";"), "[,/]", ";")
    return F.filter(F.transform(F.split(marked, ";"), strip), lambda p: p != "")


#: Types of places as gazetteers give them, with the precision of their point. Fixed values.
PRECISION = {
    "admin_comuna": "commune",
    "comuna": "commune",
    "admin_provincia": "commune",
    "admin_region": "commune",
    "regi\xa2n administrativa": "commune",
    "centro poblado": "neighborhood",
    "ciudad": "neighborhood",
    "pueblo": "neighborhood",
    "aldea": "neighborhood",
    "localidad rural": "neighborhood",
    "localidad o area": "neighborhood",
    "localidad": "neighborhood",
    "caserio": "neighborhood",
    "villorrio": "neighborhood",
    "villa": "neighborhood",
}


def spatial_precision(place_type: Column) -> Column:
    """How exact a place of the type is: commune, neighborhood, or else a point of interest."""
    kind = norm_geo(place_type)
    return F.when(kind.isin(*(k for k, p in PRECISION.items() if p == "commune")), "commune").when(kind.isin(*(k for k, p in PRECISION.items() if p == "neighborhood")), "neighborhood").otherwise("poi")


def number_or_null(text: Column) -> Column:
    """A decimal number as it is usually written, or null."""
    return strip(text.cast("string")).try_cast("double")
