"""Licence scans by ordered signature rules, in DataFrame and SQL functions only.

Texts are lower-cased (A-Z) and reduced to words joined by one space.  A rule has a
label, a priority, a keyword and a pattern over whole words.  One pass over the text
with a prefix tree of all keywords lists those that occur in it, and only the rules of
these are tried.  What they find are intervals of words; an interval that lies inside
another of higher priority, or inside a longer one of the same priority, is
suppressed.  Rules are rows of an array literal, so the plan does not grow with them.

Base phrases and their labels stay whatever the rules say.

Cases: null and empty texts have no words, no labels and score 0; repeated rows each
get the result; an empty table gives an empty result; extra columns pass through,
columns named as the results are replaced.  Cost inside one document grows with its
words, and with the square of the intervals that rules find in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

WORD = "[0-9a-z\\u0080-\\x{10FFFF}]"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # larger wins
    keyword: str  # a word of the text begins with it
    pattern: str  # over words joined by one space; matched between spaces


def _family(label: str, priority: int, keyword: str, *patterns: str) -> Iterator[Rule]:
    for p in patterns:
        yield Rule(label, priority, keyword, p)


_THE = "(?:the )?"
_VERSION = "(?:version |v)?"
_OR_LATER = "(?: or (?:(?:at your option )?any )?(?:later|newer)(?: version)?)"


def rules() -> tuple[Rule, ...]:
    """All rules, in order of priority and then as listed."""
    out: list[Rule] = []
    # Families with versions: full name, abbreviation, identifier.
    gnu = {"gpl": ("gnu general public licen[cs]e", "(?:gnu )?gpl", ("1", "2", "3")), "lgpl": ("gnu (?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl", ("2", "2 1", "3")), "agpl": ("gnu affero general public licen[cs]e", "(?:gnu )?agpl", ("1", "3"))}
    for name, (full, short, versions) in gnu.items():
        key = {"gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl"}[name]
        for v in versions:
            label = f"{name}-{v.replace(' ', '.')}"
            zero = "(?: 0)?"
            out += _family(f"{label}-or-later", 5, "general public", f"{full} (?:as published by the free software foundation )?(?:either )?{_VERSION}{v}{zero}(?: of the licen[cs]e)?{_OR_LATER}")
            out += _family(f"{label}-or-later", 5, key, f"{short} ?{_VERSION}{v}{zero}{_OR_LATER}", f"{short} ?{_VERSION}{v}{zero} or later", f"{name} {v}{zero} plus")
            out += _family(f"{label}-only", 5, key, f"{short} {_VERSION}{v}{zero} only", f"{short} only {_VERSION}{v}")
            out += _family(label, 4, "general public", f"{full} {_VERSION}{v}{zero}", f"{full} as published by the free software foundation {_VERSION}{v}{zero}", f"version {v}{zero} of {_THE}{full}")
            out += _family(label, 4, key, f"{short} {_VERSION}{v}{zero}", f"{name}v{v.split(' ')[0]}")
        out += _family(name, 2, "general public", full)
        out += _family(name, 1, key, f"licen[cs]ed? (?:under )?{_THE}{short}", f"{short} licen[cs]ed?", f"spdx license identifier {name}")
    for v in ("1 0", "1 1", "2 0"):
        label = f"apache-{v.replace(' ', '.')}"
        out += _family(label, 4, "apache", f"apache (?:software )?licen[cs]e {_VERSION}{v}", f"apache {v} licen[cs]e", f"apache {_VERSION}{v}")
        out += _family(label, 4, f"asl {v}", f"asl {v}")
        out += _family(label, 4, "licenses license", f"licenses license {v}")
        out += _family(label, 4, "licences license", f"licences license {v}")
    out += _family("apache", 2, "apache", "apache (?:software )?licen[cs]e", "apache org licenses", "licen[cs]ed to the apache software foundation")
    for kind, key in (("by", "attribution"), ("by-sa", "sharealike"), ("by-nc", "noncommercial"), ("by-nd", "noderivatives"), ("by-nc-sa", "noncommercial"), ("by-nc-nd", "noncommercial")):
        words = kind.replace("-", " ")
        long = "attribution" + {"by": "", "by-sa": "(?: share ?alike)", "by-nc": "(?: non ?commercial)", "by-nd": "(?: no ?deriv(?:ative)?s?)", "by-nc-sa": "(?: non ?commercial share ?alike)", "by-nc-nd": "(?: non ?commercial no ?deriv(?:ative)?s?)"}[kind]
        order = 3 + kind.count("-")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{kind}-{v.replace(' ', '.')}"
            out += _family(label, order + 1, "cc", f"cc {words} {v}", f"cc{words.replace(' ', '')} {v}")
            out += _family(label, order + 1, "commons", f"creative commons {long} {v}(?: (?:international|unported|generic))?")
            out += _family(label, order + 1, "creativecommons", f"creativecommons org licenses {words} {v}")
        out += _family(f"cc-{kind}", order, "cc", f"cc {words}")
        out += _family(f"cc-{kind}", order, "commons", f"creative commons {long}")
        out += _family(f"cc-{kind}", order, "creativecommons", f"creativecommons org licenses {words}")
    out += _family("cc0-1.0", 6, "cc0", "cc0(?: 1 0)?(?: universal)?")
    out += _family("cc0-1.0", 6, "commons", "creative commons (?:cc0|zero)(?: 1 0)?")
    out += _family("mit", 3, "mit licen", "mit licen[cs]e")
    out += _family("mit", 3, "mit style licen", "mit style licen[cs]e")
    out += _family("mit", 3, "licen", "licen[cs]ed under (?:the )?mit")
    out += _family("mit", 3, "spdx license identifier", "spdx license identifier mit")
    out += _family("mit", 3, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software")
    out += _family("mit", 3, "the above copyright notice", "the above copyright notice and this permission notice shall be included")
    for n, count in (("2", "two"), ("3", "three"), ("4", "four")):
        out += _family(f"bsd-{n}-clause", 4, "bsd", f"bsd {n} clause(?: licen[cs]e)?", f"{n} clause bsd(?: licen[cs]e)?", f"{count} clause bsd(?: licen[cs]e)?")
    out += _family("bsd", 2, "bsd", "bsd licen[cs]e", "bsd style licen[cs]e", "licen[cs]ed under (?:the )?bsd", "new bsd licen[cs]e", "simplified bsd licen[cs]e")
    out += _family("bsd", 2, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted")
    for short, long, versions in (("mpl", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")), ("epl", "eclipse public licen[cs]e", ("1 0", "2 0")), ("cddl", "common development and distribution licen[cs]e", ("1 0", "1 1")), ("cpl", "common public licen[cs]e", ("1 0",)), ("osl", "open software licen[cs]e", ("2 1", "3 0")), ("afl", "academic free licen[cs]e", ("2 1", "3 0")), ("eupl", "european union public licen[cs]e", ("1 1", "1 2")), ("ofl", "sil open font licen[cs]e", ("1 0", "1 1")), ("odbl", "open database licen[cs]e", ("1 0",)), ("artistic", "artistic licen[cs]e", ("1 0", "2 0")), ("gfdl", "gnu free documentation licen[cs]e", ("1 1", "1 2", "1 3")), ("ms-pl", "microsoft public licen[cs]e", ()), ("psf", "python software foundation licen[cs]e", ("2 0",)), ("php", "php licen[cs]e", ("3 0", "3 01")), ("zpl", "zope public licen[cs]e", ("2 0", "2 1")), ("bsl", "boost software licen[cs]e", ("1 0",)), ("busl", "business source licen[cs]e", ("1 1",)), ("sspl", "server side public licen[cs]e", ("1 0",)), ("cecill", "cecill", ("2 0", "2 1")), ("upl", "universal permissive licen[cs]e", ("1 0",))):
        key = long.split(" ")[0]
        for v in versions:
            label = f"{short}-{v.replace(' ', '.')}"
            out += _family(label, 4, key, f"{long} {_VERSION}{v}")
            out += _family(label, 4, short.replace("-", " ") + " ", f"{short.replace('-', ' ')} {_VERSION}{v}")
        out += _family(short, 2, key, long)
    for label, key, pattern in (("isc", "isc", "isc licen[cs]e"), ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"), ("unlicense", "unlicense", "(?:the )?unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("openssl", "openssl", "openssl licen[cs]e"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[cs]e"), ("postgresql", "postgresql", "postgresql licen[cs]e"), ("vim", "vim licen", "vim licen[cs]e"), ("ruby", "ruby licen", "ruby licen[cs]e"), ("public-domain", "public domain", "(?:is )?(?:released |placed |dedicated )?(?:in|into|to) the public domain"), ("all-rights-reserved", "all rights reserved", "all rights reserved"), ("proprietary", "proprietary", "proprietary (?:and confidential|licen[cs]e|software)")):
        out += _family(label, 2, key, pattern)
    # Wordings of headers and of whole licence texts; the keyword is how they begin.
    for label, priority, keyword, *patterns in HEADERS:
        out += _family(label, priority, keyword, *[keyword + p for p in patterns])
    return tuple(sorted(out, key=lambda r: -r.priority))


_WORDS = "(?: [^ ]+){1,12}?"
#: Label, priority, how the wording begins, how it may go on.
HEADERS = (
    ("apache-2.0", 3, "you may not use this file except in compliance with the licen", "[cs]e"),
    ("apache-2.0", 3, "unless required by applicable law or agreed to in writing", " software(?: distributed under the licen[cs]e)?"),
    ("apache-2.0", 3, "distributed under the licen", "[cs]e is distributed on an as is basis", "[cs]e is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", 3, "you may obtain a copy of the licen", "[cs]e at(?: https?)? www apache org"),
    ("apache-2.0", 3, "each contributor hereby grants to you a perpetual", " worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e"),
    ("gpl", 3, "this program is free software", " you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", 3, "you should have received a copy of the gnu general public licen", "[cs]e"),
    ("gpl", 3, "this program comes with absolutely no warranty", ""),
    ("gpl-3", 3, "the gnu general public license is a free copyleft licen", "[cs]e for software and other kinds of works"),
    ("gpl-3", 3, "this license explicitly affirms your unlimited permission to run", " the unmodified program"),
    ("gpl-2", 3, "the licenses for most software are designed to take away your freedom", " to share and change it"),
    ("gpl-2", 3, "activities other than copying distribution and modification are not covered", " by this licen[cs]e"),
    ("lgpl", 3, "this library is free software", " you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", 3, "you should have received a copy of the gnu l", "(?:esser|ibrary) general public licen[cs]e"),
    ("lgpl", 3, "a program that contains no derivative of any portion of the library", ""),
    ("agpl", 3, "you should have received a copy of the gnu affero", " general public licen[cs]e"),
    ("agpl-3", 3, "specifically designed to ensure cooperation with the community", " in the case of network server software"),
    ("gpl", 2, "this program is distributed in the hope that it will be useful", " but without any warranty"),
    ("lgpl", 2, "this library is distributed in the hope that it will be useful", " but without any warranty"),
    ("mit", 3, "to use copy modify merge publish distribute sublicense and or sell", " copies of the software"),
    ("mit", 3, "the software is provided as is without warranty of any kind", " express or implied including but not limited to the warranties of merchantability"),
    ("bsd", 3, "redistributions of source code must retain the above copyright notice", ""),
    ("bsd", 3, "redistributions in binary form must reproduce the above copyright notice", ""),
    ("bsd-3-clause", 4, "neither the name of", _WORDS + " nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 4, "the names of its contributors may not be used to endorse", " or promote products"),
    ("bsd-4-clause", 4, "all advertising materials mentioning features or use of this software", " must display the following acknowledg(?:e)?ment"),
    ("bsd", 3, "this software is provided by the copyright holders and contributors", " as is and any express or implied warranties"),
    ("isc", 3, "permission to use copy modify and ", "(?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, "the software is provided as is and the author disclaims all warranties", " with regard to this software"),
    ("zlib", 3, "this software is provided as is without any express or implied warranty", " in no event will the authors be held liable"),
    ("zlib", 3, "the origin of this software must not be misrepresented", ""),
    ("zlib", 3, "altered source versions must be plainly marked as such", ""),
    ("bsl-1.0", 3, "permission is hereby granted free of charge to any person or organization", " obtaining a copy of the software and accompanying documentation"),
    ("mpl-2.0", 4, "this source code form is subject to the terms of the mozilla", " public licen[cs]e v 2 0"),
    ("mpl-2.0", 3, "this source code form is incompatible with secondary licenses", ""),
    ("mpl-1.1", 4, "the contents of this file are subject to the mozilla", " public licen[cs]e version 1 1"),
    ("mpl", 3, "the contents of this file are subject to the mozilla", " public licen[cs]e"),
    ("cddl", 3, "the contents of this file are subject to the terms of the common development", " and distribution licen[cs]e"),
    ("epl", 3, "this program and the accompanying materials are made available under the terms of the eclipse", " public licen[cs]e"),
    ("epl-2.0", 4, "this program and the accompanying materials are made available under the terms of the eclipse", " public licen[cs]e (?:v )?2 0"),
    ("unlicense", 4, "this is free and unencumbered software released into the public domain", ""),
    ("unlicense", 3, "anyone is free to copy modify publish use compile sell or distribute", " this software"),
    ("cc0-1.0", 4, "to the extent possible under law", _WORDS + " waived all copyright and related or neighboring rights"),
    ("cc", 2, "this work is licensed under a creative commons", "(?: [^ ]+){0,8} licen[cs]e"),
    ("cc", 2, "licensed under a creative commons", "(?: [^ ]+){0,8} licen[cs]e"),
    ("ofl-1.1", 4, "this font software is licensed under the sil open font licen", "[cs]e version 1 1"),
    ("ofl", 3, "the font software may be sold as part of a larger software package", ""),
    ("artistic", 3, "the intent of this document is to state the conditions under which a package", " may be copied"),
    ("postgresql", 3, "permission to use copy modify and distribute this software and its documentation for any purpose", " without fee and without a written agreement is hereby granted"),
    ("psf", 3, "psf is making python available to licensee on an as is basis", ""),
    ("openssl", 3, "this product includes software developed by the openssl project", " for use in the openssl toolkit"),
    ("gfdl", 3, "permission is granted to copy distribute and or modify this document under the terms of the gnu", " free documentation licen[cs]e"),
    ("eupl", 3, "licensed under the eupl", "(?: version 1 [0-2])?"),
    ("proprietary", 2, "this software is the confidential and proprietary information of", ""),
    ("proprietary", 2, "unauthorized copying of this file via any medium is strictly prohibited", ""),
    ("proprietary", 2, "no part of this publication may be reproduced", "(?: [^ ]+){0,12} without (?:the )?(?:prior )?(?:written )?permission"),
    ("public-domain", 3, "the author disclaims copyright to this source code", ""),
    ("public-domain", 2, "this file has been put into the public domain", ""),
)


def prefix_tree(keywords: Iterable[str]) -> str:
    """A pattern that matches the longest of the keywords at a place; they consist of a-z, 0-9 and spaces."""
    by: dict[str, list[str]] = {}
    for k in keywords:
        by.setdefault(k[:1], []).append(k[1:])
    ends = by.pop("", None) is not None
    ways = [c + prefix_tree(rest) for c, rest in sorted(by.items())]
    if not ways:
        return ""
    joined = ways[0] if len(ways) == 1 and not ends else "(?:" + "|".join(ways) + ")"
    return joined + "?" if ends else joined


def normalized(text: Column) -> Column:
    """Words joined by one space, with a space at both ends (one space if there are none)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), upper, upper.lower())
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _marked(norm: Column, pattern: Column) -> Column:
    """Pieces of the text: each but the first begins with a match and \\u0001."""
    return F.split(F.regexp_replace(norm, F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )")), F.lit("\u0002$0\u0001")), "\u0002")


def _intervals(norm: Column, rule: Column) -> Column:
    """(start, end, priority, label) of a rule's matches, in words."""
    state = F.aggregate(
        _marked(norm, rule.pattern),
        F.struct(F.lit(-1).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,priority:int,label:string>>)").alias("got")),
        lambda acc, piece: F.struct(
            (acc.at + _spaces(piece)).alias("at"),
            F.when(F.instr(piece, "\u0001") > 0, F.concat(acc.got, F.array(F.struct(acc.at.alias("start"), (acc.at + _spaces(F.substring_index(piece, "\u0001", 1)) + 1).alias("end"), rule.priority.alias("priority"), rule.label.alias("label"))))).otherwise(acc.got).alias("got"),
        ),
        lambda acc: acc.got,
    )
    return state


def scan(docs: DataFrame, text: str = "text", using: tuple[Rule, ...] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections (start, end, priority, label)."""
    using = rules() if using is None else using
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    lit = lambda r: F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"))
    all_rules = F.array(*[lit(r) for r in using])
    base_rules = F.array(*[lit(Rule(label, 0, phrase, phrase)) for phrase, label in BASE.items()])
    keywords = {r.keyword for r in using} | set(BASE)
    df = own.withColumn("__norm", normalized(F.col(f"`{text}`")))
    # The keywords that occur; of those that begin alike the longest at each place, and so the others with it.
    df = df.withColumn("__hits", F.array_distinct(F.regexp_extract_all("__norm", F.lit(f" (?=({prefix_tree(keywords)}))"), F.lit(1))))
    gated_by = lambda some: F.filter(some, lambda r: F.exists("__hits", lambda h: F.startswith(h, r.keyword)))
    none = F.expr("cast(array() as array<struct<label:string,priority:int,keyword:string,pattern:string>>)")
    gated, gated_base = (F.when(F.size("__hits") > 0, gated_by(some)).otherwise(none) for some in (all_rules, base_rules))
    df = df.withColumn("__base", F.flatten(F.transform(gated_base, lambda r: _intervals(F.col("__norm"), r))))
    df = df.withColumn("__all", F.array_sort(F.array_distinct(F.flatten(F.transform(gated, lambda r: _intervals(F.col("__norm"), r))))))
    inside = lambda d, e: (e.start <= d.start) & (e.end >= d.end) & ((e.priority > d.priority) | (e.priority == d.priority) & (e.end - e.start > d.end - d.start))
    df = df.withColumn("detections", F.filter("__all", lambda d: ~F.exists("__all", lambda e: inside(d, e))))
    n_words = (F.length("__norm") - F.length(F.replace("__norm", F.lit(" "), F.lit(""))) - 1).cast("long")
    covered = F.aggregate("detections", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), lambda a, d: F.struct(F.greatest(a.to, d.end).alias("to"), (a.n + F.greatest(F.lit(0), d.end - F.greatest(a.to, d.start))).alias("n")), lambda a: a.n)
    labels = lambda c: F.transform(c, lambda d: d.label)
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d.priority)), F.lit(0))
    return df.select(
        *own.columns,
        n_words.alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(F.transform("__base", lambda d: d.start)).cast("long").alias("first_word"),
        F.array_max(F.transform("__base", lambda d: d.start)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels("__base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels("__base"), labels("detections")))), ",").alias("labels"),
        # Certainty of the strongest rule, raised by the share of words that are covered.
        F.when(F.size("detections") == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.4 + 0.1 * best + 0.2 * covered / F.greatest(n_words, F.lit(1)))).cast("double").alias("score"),
        "detections",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("text", "detections")
