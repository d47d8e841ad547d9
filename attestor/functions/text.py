"""Column builders over text: tokens, folding, numbers and figures. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------
DASHES = "‐‑‒–—−"
TOKEN = r"\d+(?:[.,]\d+)*|[a-z][a-z0-9]*(?:-[a-z0-9]+)*"
NUMBER_TOKEN = r"^\d+(?:[.,]\d+)*$"
STOP_WORDS = (
    "a an and are as at be been by for from has have in is it its of on or that the this to was were will with which who "
    "than then there these those into after before during"
).split()
SYNONYMS = {"a1c": "hba1c", "hba1c": "a1c", "glp1": "glp-1"}
NUMBER = r"\d+(?:[.,]\d+)*"
SMALL_WITH_UNIT = (
    r"(?i)(?<![\d.,])(\d{1,2})\s*(?:%|mg\b|mcg\b|kg\b|years?\b|yrs?\b|months?\b|weeks?\b|days?\b|hours?\b|times?\b|and (?:older|over|up)\b)"
)
SMALL_WITH_AGE = r"(?i)\b(?:aged?|ages|as young as|older than|younger than|under|over)\s+(\d{1,2})\b(?![.,]\d)"
AGE_YEARS = r"(?i)(\d{1,2})\s*(?:years?|yrs?)(?:\s+of\s+age)?(?:\s+and\s+(?:older|over|up))?"
AGE_WORDS = r"(?i)(?:aged?|as young as)\s+(\d{1,2})\b"
#: Characters that a quotation may spell differently, and what they fold to.
FOLD_FROM = "‘’“”‐‑‒–—−   •|"
FOLD_TO = "''\"\"------     "
FOLD_DROP = "­"
# -----------------------------------------------------------------------------------------------------------------


def dashes(c: Column) -> Column:
    for dash in DASHES:  # searches that mostly find nothing: a translation looks up every character
        c = F.replace(c, F.lit(dash), F.lit("-"))
    return c


def tokenize(c: Column) -> Column:
    """Lower-cased tokens in order, numbers and hyphenated words whole, without stop words; null gives no tokens."""
    found = F.regexp_extract_all(dashes(F.lower(F.coalesce(c, F.lit("")))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def query_terms(c: Column) -> Column:
    """Distinct tokens of a query with the other spelling of those that have one."""
    other = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    tokens = tokenize(c)
    return F.array_distinct(F.concat(tokens, F.filter(F.transform(tokens, lambda t: other[t]), lambda t: t.isNotNull())))


def is_number(c: Column) -> Column:
    return c.rlike(NUMBER_TOKEN)


def norm_number(c: Column) -> Column:
    """1,306 -> 1306, 15.0 -> 15, 007 -> 7."""
    plain = F.replace(c, F.lit(","), F.lit(""))
    whole = F.regexp_replace(plain, r"^0+(?=\d)", "")
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.+$", "")).otherwise(whole)


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


def numbers(c: Column) -> Column:
    """Every number of a text in normal form, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(_all(c, NUMBER, 0), norm_number)))


def figures(c: Column) -> Column:
    """The figures that a claim states: decimals, whole numbers above 10, and smaller ones with a unit or an age."""
    large = F.filter(F.transform(_all(c, NUMBER, 0), norm_number), lambda n: F.contains(n, F.lit(".")) | (F.length(n) > 2) | (n.cast("int") > 10))
    small = F.transform(F.concat(_all(c, SMALL_WITH_UNIT, 1), _all(c, SMALL_WITH_AGE, 1)), lambda n: n.cast("int").cast("string"))
    return F.array_sort(F.array_distinct(F.concat(large, small)))


def ages(c: Column) -> Column:
    found = F.concat(_all(c, AGE_YEARS, 1), _all(c, AGE_WORDS, 1))
    return F.array_distinct(F.transform(F.filter(found, lambda n: n != ""), lambda n: n.cast("int").cast("string")))


def plain(c: Column) -> Column:
    """Dashes folded and white space collapsed, no-break spaces included."""
    return F.trim(F.regexp_replace(dashes(c), r"(?U)\s+", " "))


def folded(c: Column) -> Column:
    """A text as quotations are compared: marks skipped, variants folded, white space collapsed, lower case. A pass over
    the text that has nothing to do is left out: plain searches tell."""
    unmarked = c
    for pattern in (r"(?m)^[ \t]*- ", rf"(?U)(?:(?<=\s)|^)[-{DASHES}](?= )", r"\^(?=[®™])", r"\^[0-9a-z*,†‡§]{1,4}(?![0-9A-Za-z])", r"(?iU)\s*\[see [^\]]*\]"):
        unmarked = F.regexp_replace(unmarked, pattern, " " if pattern.startswith("(?m)") else "")
    variants = lambda x: F.replace(F.replace(F.translate(x, FOLD_FROM + FOLD_DROP, FOLD_TO), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    marked = F.contains(c, F.lit("^")) | F.contains(c, F.lit("["))
    for dash in "-" + DASHES:
        marked = marked | F.contains(c, F.lit(dash + " "))
    varied = F.contains(c, F.lit("|")) | (F.octet_length(c) > F.length(c))
    out = F.when(marked, variants(unmarked)).when(varied, variants(c)).otherwise(c)
    return F.lower(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")))


def clip(c: Column, size: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size - 1), F.lit("…")))


def estimate_tokens(c: Column) -> Column:
    return (F.length(c) / 3.5).cast("int") + 1


def hash_bucket(word: Column, dim: int = 64) -> Column:
    """md5 of a word modulo dim, a power of two up to 256."""
    return F.conv(F.right(F.md5(word.cast("binary")), F.lit(2)), 16, 10).cast("int") % dim


def dot(a: Column, b: Column, dim: int = 64) -> Column:
    """Dot product of two arrays of dim numbers, written out so that it is compiled and not interpreted."""
    total = a[0].cast("double") * b[0].cast("double")
    for i in range(1, dim):
        total = total + a[i].cast("double") * b[i].cast("double")
    return total
