"""Normalisation of names and addresses as column expressions.

Only Unicode normal forms need Python (Spark has no function for them): ``nfkc`` and ``ascii_fold`` are Arrow UDFs, everything
else runs in the JVM. Missing text is the empty string throughout. Word boundaries are written with explicit classes,
because combining marks are no word characters here.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal forms, address abbreviations, landmark words, punctuation and domains.
LEGAL_FORMS = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "l l c", "llp", "l l p", "pllc", "pc", "ltd",
    "pvt", "private", "limited", "opc",
    "sarl", "sas", "sasu", "eurl", "sci", "sa", "ei", "auto entrepreneur",
    "group", "holdings", "enterprises", "associates", "partners", "dba", "d b a", "t a", "trading as",
)
ABBREVIATIONS = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard", "dr": "drive",
    "ln": "lane", "apt": "apartment", "bldg": "building", "fl": "floor", "hwy": "highway", "ct": "court", "pl": "place", "sq": "square",
    "near": "near", "opp": "opposite", "chs": "cooperative housing society", "soc": "society", "ch": "chemin", "imp": "impasse",
}
LANDMARKS = ("near", "opp", "opposite", "behind", "next to", "beside", "adjacent to")
PUNCTUATION = "!\"$%()*+,./:;<=>?@[]\\^_`{|}~“”‘’«»—–…•"
DOMAINS = ("com", "net", "org", "in", "co", "co\\.in", "fr", "io")
SCRIPTS = {
    "devanagari": (0x0900, 0x097F), "bengali": (0x0980, 0x09FF), "gurmukhi": (0x0A00, 0x0A7F), "gujarati": (0x0A80, 0x0AFF),
    "tamil": (0x0B80, 0x0BFF), "telugu": (0x0C00, 0x0C7F), "kannada": (0x0C80, 0x0CFF), "malayalam": (0x0D00, 0x0D7F),
}

_W = r"[\p{L}\p{N}_]"
_BEFORE, _AFTER = rf"(?<!{_W})", rf"(?!{_W})"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Without combining characters after decomposition."""
    return text.map(lambda s: s if s is None or s.isascii() else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def present(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _spaced(text: Column) -> Column:
    """White space of any kind made one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def clean_name(raw: Column, normalise: bool = True) -> Column:
    """Before the first pipe, without addresses of the web (unless nothing else is left), hash signs and punctuation; in lower case."""
    text = F.regexp_replace(nfkc(present(raw)) if normalise else present(raw), r"(?sU)\s*\|.*", "")
    web = rf"(?iU)https?://\S+|{_BEFORE}www\.\S+|{_BEFORE}{_W}[\p{{L}}\p{{N}}_-]*\.(?:{'|'.join(DOMAINS)}){_AFTER}"
    bare = F.regexp_replace(text, web, " ")
    text = F.when(bare.rlike(r"(?U)\S"), bare).otherwise(text)
    text = F.regexp_replace(text, rf"#({_W}+)", "$1")
    text = F.regexp_replace(text, r"(?U)\s*&\s*", " and ")
    return F.lower(_spaced(without_punctuation(text)))


def _legal_pattern() -> str:
    return rf"(?i){_BEFORE}({'|'.join(sorted(LEGAL_FORMS, key=len, reverse=True))}){_AFTER}"


def legal_forms(clean: Column) -> Column:
    """The distinct legal forms in a clean name in order, joined by commas; empty if none."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(F.lower(clean), F.lit(_legal_pattern()), F.lit(1))), ",")


def core_name(clean: Column) -> Column:
    """A clean name without legal forms; the clean name if nothing is left."""
    core = _spaced(F.regexp_replace(clean, _legal_pattern(), " "))
    core = F.regexp_replace(core, r"(?U)^[\s'-]+|[\s'-]+$", "")
    return F.when(clean.rlike(_legal_pattern()) & (core != ""), core).otherwise(clean)


def clean_address(raw: Column, normalise: bool = True) -> Column:
    """In lower case, without punctuation, abbreviations written out."""
    text = F.lower(nfkc(present(raw)) if normalise else present(raw))
    words = F.filter(F.split(_spaced(without_punctuation(text)), " "), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def landmark(address: Column) -> Column:
    """From the first landmark word of a clean address to its end; empty if none."""
    words = "|".join(w for w in LANDMARKS)
    return F.regexp_extract(address, rf"(?iU){_BEFORE}(?:{words}){_AFTER}\s+[^,]+", 0)


def words(text: Column, least: int = 2) -> Column:
    """Distinct words of a clean text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: F.length(w) >= least)))


def address_words(address: Column) -> Column:
    return F.filter(words(F.translate(address, ",", " ")), lambda w: ~w.rlike(r"^\p{Nd}+$"))


def numbers(raw: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(present(raw), F.lit(r"\p{Nd}+"), F.lit(0))))


def char_ngrams(text: Column, n: int = 4) -> Column:
    """Distinct n-grams of the text between two spaces on either side, sorted."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - n + 1)), lambda i: F.substring(padded, i, F.lit(n)))
    return F.array_sort(F.array_distinct(grams))


def prefix(core: Column, n: int = 4, least: int = 3) -> Column:
    """The first characters of a core name as a key; null if too short."""
    return F.when(F.length(F.substring(core, 1, n)) >= least, F.substring(core, 1, n))


def script_flags(text: Column) -> Column:
    """A struct of booleans: each Indic script, other letters beyond ASCII, any Indic script."""
    spans = {name: f"[\\x{{{lo:04x}}}-\\x{{{hi:04x}}}]" for name, (lo, hi) in SCRIPTS.items()}
    indic = "".join(f"\\x{{{lo:04x}}}-\\x{{{hi:04x}}}" for lo, hi in SCRIPTS.values())
    flags = [present(text).rlike(p).alias(name) for name, p in spans.items()]
    other = present(text).rlike(rf"[\p{{L}}&&[^\x00-\x7F{indic}]]").alias("non_latin_other")
    return F.struct(*flags, other, present(text).rlike(f"[{indic}]").alias("any_indic"))


def has_indic(text: Column) -> Column:
    return text.rlike(r"[\x{0901}-\x{0D7E}]")


def id_list(text: Column) -> Column:
    """The ids of a comma-joined list."""
    return F.filter(F.split(present(text), ","), lambda i: i != "")
