"""License detection with ordered signature rules, and the query op7. Only DataFrame functions are used.

A text is reduced to its words, lower-cased and joined by single spaces, so that a rule is a regular expression over
words. Rules are made from families of licenses times the forms in which a license is named (identifier, title with
version, "licensed under", "or later", body phrases); each has a label, a priority, a score and a keyword. A text is
matched only against the rules whose keyword it holds. Of overlapping detections the higher priority wins, and at one
priority the one that contains the other: a detection is suppressed if one of a higher priority shares a word with it, or
one of its own priority starts no later, ends no earlier and is larger or ranks before it. Overlaps are resolved by
running extremes over a text's detections in order of their starts, so that a text with very many detections takes no
more than a sort.

Defined cases: null is empty; a text without words has no detections, no labels and the score 0; rows that repeat a
doc_id and its text are one document; rows of one doc_id with different texts are scanned apart and reported together
(places add up, n_words is the largest); an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

#: Fixed values of the contract: phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: What separates words, after A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """pattern: over space-joined words, without the spaces around; a higher priority is more specific."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def _versioned(name: str, title: str, short: str, versions: tuple[str, ...], keyword: str, later: bool) -> list[Rule]:
    """Rules of one family: by identifier, title and version, "or later", and the bare title."""
    out = [Rule(name, keyword, title, 1, 0.6)]
    for v in versions:
        digits = v.replace(".", " ")
        optional = digits.removesuffix(" 0")
        number = f"{optional}(?: 0)?(?! \\d)" if optional != digits or " " not in digits else digits
        label = f"{name}-{v}"
        out += [
            Rule(label, keyword, f"{title} (?:v|version |v ){{0,1}}{number}", 2, 0.95),
            Rule(label, short, f"{short}(?: (?:v|version |v )?|v ?){number}", 2, 0.9),
            Rule(label, short, f"spdx license identifier {short} {digits}(?: only)?", 3, 1.0),
            Rule(label, short, f"{short} {digits}(?: only)", 3, 0.95),
            Rule(label, keyword, f"version {number} of the {title}", 3, 1.0),
            Rule(label, keyword, f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?{title} (?:v|version |v ){{0,1}}{number}", 3, 1.0),
        ]
        if later:
            more = f"{label}-or-later"
            out += [
                Rule(more, short, f"{short}(?: (?:v|version |v )?|v ?){number} or (?:any )?later(?: version)?", 4, 1.0),
                Rule(more, keyword, f"{title} (?:v|version |v ){{0,1}}{number} or (?:at your option )?(?:any )?later(?: version)?", 4, 1.0),
                Rule(more, keyword, f"either version {number} of the (?:{title}|license) or at your option any later version", 4, 1.0),
            ]
    return out


def rules() -> tuple[Rule, ...]:
    """All rules, the contract's phrases among them (priority 1)."""
    out = [Rule(label, phrase.split()[0], phrase, 1, 0.6) for phrase, label in BASE]
    families = (
        ("gpl", "gnu general public license", "gpl", ("1.0", "2.0", "3.0"), "gnu", True),
        ("lgpl", "gnu (?:lesser|library) general public license", "lgpl", ("2.0", "2.1", "3.0"), "gnu", True),
        ("agpl", "gnu affero general public license", "agpl", ("1.0", "3.0"), "affero", True),
        ("gfdl", "gnu free documentation license", "gfdl", ("1.1", "1.2", "1.3"), "gnu", True),
        ("apache", "apache (?:software )?license", "apache", ("1.0", "1.1", "2.0"), "apache", False),
        ("mpl", "mozilla public license", "mpl", ("1.0", "1.1", "2.0"), "mozilla", False),
        ("epl", "eclipse public license", "epl", ("1.0", "2.0"), "eclipse", False),
        ("cddl", "common development and distribution license", "cddl", ("1.0", "1.1"), "distribution", False),
        ("eupl", "european union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2"), "european", False),
        ("osl", "open software license", "osl", ("1.0", "2.0", "2.1", "3.0"), "software", True),
        ("afl", "academic free license", "afl", ("1.1", "1.2", "2.0", "2.1", "3.0"), "academic", False),
        ("artistic", "artistic license", "artistic", ("1.0", "2.0"), "artistic", False),
        ("cpl", "common public license", "cpl", ("1.0",), "common", False),
        ("bsl", "boost software license", "bsl", ("1.0",), "boost", False),
        ("upl", "universal permissive license", "upl", ("1.0",), "permissive", False),
        ("ofl", "sil open font license", "ofl", ("1.0", "1.1"), "font", False),
        ("zpl", "zope public license", "zpl", ("1.1", "2.0", "2.1"), "zope", False),
        ("psf", "python software foundation license", "psf", ("2.0",), "python", False),
        ("php", "php license", "php", ("3.0", "3.01"), "php", False),
        ("lppl", "latex project public license", "lppl", ("1.0", "1.1", "1.2", "1.3"), "latex", False),
    )
    for name, title, short, versions, keyword, later in families:
        out += _versioned(name, title, short, versions, keyword, later)
    for n, words in ((0, "zero"), (2, "two"), (3, "three"), (4, "four")):
        for form, score in ((f"bsd {n} clause(?: license)?", 1.0), (f"{n} clause bsd(?: license)?", 1.0), (f"bsd {words} clause(?: license)?", 1.0), (f"{words} clause bsd(?: license)?", 1.0)):
            out.append(Rule(f"bsd-{n}-clause", "bsd", form, 3, score))
    out += [Rule("bsd", "bsd", form, 1, 0.7) for form in ("bsd licen[cs]e", "bsd style licen[cs]e", "licensed under (?:the )?bsd")]
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        name = "cc-" + parts.replace(" ", "-")
        longer = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:s|atives|ative works)?"}
        title = " ".join(longer[p] for p in parts.split())
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            digits = v.replace(".", " ")
            out += [
                Rule(f"{name}-{v}", "cc", f"cc {parts} {digits}", 3, 1.0),
                Rule(f"{name}-{v}", "creative", f"creative commons {title} {digits}(?: (?:international|unported|generic))?(?: (?:public )?license)?", 3, 1.0),
            ]
        if parts != "by":
            out.append(Rule(name, "cc", f"cc {parts}", 2, 0.8))
        out.append(Rule(name, "creative", f"creative commons {title}", 2, 0.8))
    out += [Rule("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?", 3, 1.0), Rule("cc0-1.0", "dedication", "public domain dedication", 2, 0.7)]
    for label, keyword, forms in (
        ("mit", "mit", ("(?:licensed|released|distributed|available) under (?:the )?mit(?: license)?", "mit licen[cs]ed?", "spdx license identifier mit", "mit expat(?: license)?")),
        ("mit", "hereby", ("permission is hereby granted free of charge to any person obtaining a copy of this software",)),
        ("isc", "isc", ("isc license", "spdx license identifier isc", "licensed under (?:the )?isc")),
        ("isc", "permission", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
        ("bsd", "redistribution", ("redistribution and use in source and binary forms with or without modification are permitted",)),
        ("bsd-3-clause", "endorse", ("may be used to endorse or promote products derived from this software without specific prior written permission",)),
        ("bsd-4-clause", "advertising", ("all advertising materials mentioning features or use of this software must display the following acknowledgement",)),
        ("unlicense", "unlicense", ("unlicense", "spdx license identifier unlicense")),
        ("unlicense", "unencumbered", ("free and unencumbered software released into the public domain",)),
        ("zlib", "zlib", ("zlib license", "zlib libpng license", "spdx license identifier zlib")),
        ("wtfpl", "wtfpl", ("wtfpl",)),
        ("public-domain", "public", ("released into the public domain", "dedicated to the public domain")),
        ("ncsa", "ncsa", ("university of illinois ncsa open source license", "ncsa license")),
        ("postgresql", "postgresql", ("postgresql license",)),
        ("openssl", "openssl", ("openssl license", "openssl ssleay license")),
        ("proprietary", "rights", ("all rights reserved",)),
        ("beerware", "beer", ("beer ware license", "beerware license")),
        ("json", "evil", ("shall be used for good not evil",)),
        ("gpl", "gnu", ("licensed under (?:the )?gnu gpl", "gnu gpl")),
        ("lgpl", "lgpl", ("licensed under (?:the )?(?:gnu )?lgpl",)),
        ("apache", "apache", ("licensed under (?:the )?apache", "apache software foundation asf under one or more contributor license agreements")),
        ("apache", "asl", ("asl 2 0",)),
    ):
        out += [Rule(label, keyword, form, 2 if len(form) < 40 else 3, 0.9 if len(form) < 40 else 1.0) for form in forms]
    return tuple(out)


PRIORITIES = (1, 2, 3, 4)
#: Characters that words cannot hold; they mark where a match starts and ends.
OPEN, CLOSE = "\x01", "\x02"


def matches(text: Column, rule: Column) -> Column:
    """Detections of one rule in a text of the form " word word ", as structs with the word they start at and the word
    after them. Each match gets marks at its ends, and the words that bear marks are numbered: two passes over the text,
    however many matches there are."""
    marked = F.regexp_replace(text, F.concat(F.lit(" ("), rule["pattern"], F.lit(")(?= )")), F.lit(f" {OPEN}$1{CLOSE}"))
    words = F.split(F.trim(marked), " ")
    at = lambda mark: F.filter(F.transform(words, lambda w, i: F.when(mark(w), i)), lambda i: i.isNotNull())
    starts, ends = at(lambda w: F.startswith(w, F.lit(OPEN))), at(lambda w: F.endswith(w, F.lit(CLOSE)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def detections(docs: DataFrame, table: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, of: hash of the text, n_words, rule, label, priority, score, start, end, base) for each match before suppression; one row
    with nulls for a document without a match."""
    table = table or rules()
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), low.alias("low"))
    n_words = F.regexp_count("low", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    keywords = sorted({r.keyword for r in table})
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(k)), F.lit(k)) for k in keywords]), lambda k: k.isNotNull())
    docs = docs.select("doc_id", "of", "low", n_words.cast("long").alias("n_words"), held.alias("held"))
    words = F.when(F.size("held") > 0, F.concat(F.lit(" "), F.trim(F.regexp_replace("low", NO_WORD, " ")), F.lit(" ")))
    docs = docs.select("doc_id", "of", "n_words", "held", words.alias("words"))
    literal = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(table)])
    found = F.flatten(
        F.transform(
            F.filter(literal, lambda r: F.array_contains(F.col("held"), r["keyword"]) & F.regexp_like(F.col("words"), F.concat(F.lit(" (?:"), r["pattern"], F.lit(") ")))),
            lambda r: F.transform(matches(F.col("words"), r), lambda m: F.struct(r["rule"].alias("rule"), m["start"].alias("start"), m["end"].alias("end"))),
        )
    )
    docs = docs.select("doc_id", "of", "n_words", F.explode_outer(found).alias("m")).select("doc_id", "of", "n_words", "m.*")
    pick = lambda f, kind: F.when(F.col("rule").isNotNull(), F.array(*[F.lit(f(r)) for r in table])[F.coalesce("rule", F.lit(0))]).cast(kind)
    return docs.select(
        "*", pick(lambda r: r.label, "string").alias("label"), pick(lambda r: r.priority, "int").alias("priority"),
        pick(lambda r: r.score, "double").alias("score"), (F.col("rule") < len(BASE)).alias("base"),
    )


def scan(docs: DataFrame, table: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections, n_suppressed)."""
    found = detections(docs, table).repartition("doc_id").dropDuplicates(["doc_id", "of", "rule", "start", "end"])
    text = Window.partitionBy("doc_id", "of")  # what follows is what precedes in the reverse order: a running extreme too
    before = text.orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    after = text.orderBy(F.desc("start"), "end", "priority", F.desc("rule")).rowsBetween(Window.unboundedPreceding, -1)
    loses = F.lit(False)
    for p in PRIORITIES:
        higher, same = F.col("priority") > p, F.col("priority") == p
        overlapped = (F.max(F.when(higher, F.col("end"))).over(before) > F.col("start")) | (F.min(F.when(higher, F.col("start"))).over(after) < F.col("end"))
        contained = F.max(F.when(same, F.col("end"))).over(before) >= F.col("end")
        loses = loses | (same & (F.coalesce(overlapped, F.lit(False)) | F.coalesce(contained, F.lit(False))))
    found = found.withColumn("suppressed", loses & F.col("rule").isNotNull())
    names = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")
    base, stays = F.col("base"), ~F.col("suppressed")
    return found.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(base | (stays & F.col("rule").isNotNull())).alias("labels"),
        F.coalesce(F.max(F.when(stays, F.col("score"))), F.lit(0.0)).alias("score"),
        F.count("rule").alias("n_detections"),
        F.count_if("suppressed").alias("n_suppressed"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
