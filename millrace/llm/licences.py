"""Licence scans: Dice coefficient over word bigrams against licence templates.

Every line of a document is normalised (lower case, runs of other characters
than a-z and 0-9 become one space) and compared with the templates by
``2 |A and B| / (|A| + |B|)`` over sets of word bigrams.  A Dice of t needs
set sizes within t / (2 - t) of each other, so a line meets only the
templates that its number of words admits; most lines meet none.

The text is also compared in windows of words across line breaks, against the same templates and passages of full licence texts, so
that wrapped notices, notices behind prose and whole licence texts count.  A
window's lines are licence lines; one within lines that match by themselves
adds nothing.  Only texts with one of the templates' rare
words are looked at; no other text can reach the threshold.

Only DataFrame functions.  The templates are constants of the plan.  Null and
empty texts have no lines that match.  Lines of one word have no bigram and
match nothing.  Repeated rows and rows of a null doc_id are rows of their own;
an empty table gives an empty result; other columns are ignored.  A document's best licence is the
one of greatest Dice, ties by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# fixed values: public licence notices, name and text
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# fixed values: passages by which the windows know full licence texts that hold none of the notices
PASSAGES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
)


def words_of(text: str) -> list[str]:
    import re

    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _templates(templates) -> list[tuple[str, list[str]]]:
    return [(name, bigrams_of(text)) for name, text in templates]


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, passages=PASSAGES) -> DataFrame:
    """doc_id, n_lines, n_licence_lines, licences (distinct names), best_licence and best_dice of every document."""
    known = _templates(templates)
    sizes = [len(b) for _, b in known]
    least = min(sizes) * threshold / (2 - threshold)
    most = max(sizes) * (2 - threshold) / threshold

    def once(value: Column, use) -> Column:
        """``use(value)`` with the value computed once for each row, not for each element."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def pairs(w: Column) -> Column:
        firsts = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
        return F.array_distinct(F.transform(firsts, lambda x, i: F.concat(x, F.lit(" "), F.element_at(w, (i + 2).cast("int")))))

    def bigrams(line: Column) -> Column:
        return once(F.filter(F.split(F.regexp_replace(F.translate(line, _UP, _LOW), "[^a-z0-9]+", " "), " "), lambda x: x != ""), pairs)

    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("grams"), F.lit(len(b)).alias("size")) for n, b in known])
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # a line of g distinct bigrams has over g words, so over 2 g characters: a bound that needs no words;
    # repeated words only make sets smaller, so lines above the bound need a look at their words first
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    some = F.filter(numbered, lambda x: F.length(x["line"]) >= F.lit(int(2 * least) + 1))
    every = F.array(*map(F.lit, sorted({g for _, b in known for g in b})))
    grams = F.filter(F.transform(some, lambda x: F.struct(bigrams(x["line"]).alias("g"), x["at"].alias("at"))),
                     lambda x: F.size(x["g"]).between(F.lit(least), F.lit(most)) & F.arrays_overlap(x["g"], every))

    def best(x: Column) -> Column:
        g = x["g"]
        near = F.filter(table, lambda t: (F.size(g) * (2 - threshold) >= t["size"] * threshold) & (t["size"] * (2 - threshold) >= F.size(g) * threshold))
        scored = F.transform(near, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["size"])).alias("dice"), t["name"].alias("name"), x["at"].alias("at")))
        return F.filter(scored, lambda s: s["dice"] >= threshold)

    order = lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    top = F.transform(F.filter(F.transform(grams, best), lambda s: F.size(s) > 0), lambda s: F.element_at(F.array_sort(s, order), 1))
    own = docs.select("doc_id", "text", F.size(lines).cast("long").alias("n_lines"), top.alias("own"))
    taken = F.transform("own", lambda h: h["at"])
    wide = windows([*known, *_templates(passages)], threshold)(lines)
    # windows within lines that match by themselves say nothing new
    both = own.select("doc_id", "n_lines", "own", F.filter(wide, lambda s: F.size(F.array_except(s["lines"], taken)) > 0).alias("wide")).select(
        "doc_id", "n_lines", F.size(F.array_union(taken, F.flatten(F.transform("wide", lambda s: s["lines"])))).alias("n_found"),
        F.concat(F.transform("own", lambda h: F.struct(h["dice"].alias("dice"), h["name"].alias("name"))),
                 F.transform("wide", lambda h: F.struct(h["dice"].alias("dice"), h["name"].alias("name")))).alias("hits"),
    )
    return (
        both.select("doc_id", "n_lines", F.col("n_found").cast("long").alias("n_licence_lines"),
                F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["name"]))), ",").alias("licences"),
                F.when(F.size("hits") > 0, F.element_at(F.array_sort("hits", order), 1)).alias("best"))
        .select("doc_id", "n_lines", "n_licence_lines", "licences", F.col("best.name").alias("best_licence"), F.col("best.dice").alias("best_dice"))
    )


def anchors(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which a text that matches has one at least: without them more of a template's bigrams are missing than the threshold admits."""
    out: set[str] = set()
    for _, grams in known:
        spare = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        words = sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w not in out, w in _COMMON, -len(w), w))
        lost: set[str] = set()
        for w in words:
            if len(lost) > spare:
                break
            out.add(w)
            lost |= {g for g in grams if w in g.split(" ")}
    return sorted(out)


def windows(known: list[tuple[str, list[str]]], threshold: float):
    """Function of the lines of a text that gives dice, name and lines of the windows that match, across line breaks.

    A window starts and ends with a bigram of the template and has at most
    (2 - t) / t times as many; of windows that overlap the best one stays, of a
    licence's several templates one each.
    """
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("grams"), F.lit(len(b)).alias("size")) for n, b in known])
    rare, every = F.array(*map(F.lit, anchors(known, threshold))), sorted({g for _, b in known for g in b})
    none = F.array().cast("array<struct<dice:double,name:string,size:int,a:int,z:int,lines:array<int>>>")

    def once(value: Column, use) -> Column:
        return F.element_at(F.transform(F.array(value), use), 1)

    def words(text: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(F.translate(text, _UP, _LOW), "[^a-z0-9]+", " "), " "), lambda x: x != "")

    def of_template(t: Column, g: Column, known_at: Column) -> Column:
        def ends(at: Column, a: Column, k: Column) -> Column:
            near = F.filter(F.slice(at, k + 1, F.ceil(t["size"] * (2 - threshold) / threshold).cast("int")), lambda z: ((z - a + 1) * threshold <= t["size"] * (2 - threshold)) & ((z - a + 1) * (2 - threshold) >= t["size"] * threshold))
            scored = F.transform(near, lambda z: once(F.slice(g, a, z - a + 1), lambda x: F.struct(
                (2.0 * F.size(F.array_intersect(x, t["grams"])) / (F.size(F.array_distinct(x)) + t["size"])).alias("dice"), (-z).alias("first"), z.alias("z"))))
            return F.array_max(scored)

        def matches(at: Column) -> Column:
            few = F.size(at) * (2 - threshold) < t["size"] * threshold
            found = F.transform(at, lambda a, k: once(ends(at, a, k), lambda s: F.struct(s["dice"].alias("dice"), t["name"].alias("name"), t["size"].alias("size"), a.alias("a"), s["z"].alias("z"))))
            return F.when(few, F.filter(F.array(F.struct(F.lit(0.0).alias("dice"), t["name"].alias("name"), t["size"].alias("size"), F.lit(0).alias("a"), F.lit(0).alias("z"))), lambda s: F.lit(False))).otherwise(
                F.filter(found, lambda s: s["dice"] >= threshold)
            )

        return once(F.filter(known_at, lambda k: F.array_contains(t["grams"], F.element_at(g, k))), matches)

    def of_tokens(tokens: Column) -> Column:
        firsts = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
        grams = F.transform(firsts, lambda x, i: F.concat(x["w"], F.lit(" "), F.element_at(tokens, (i + 2).cast("int"))["w"]))

        def of_grams(g: Column) -> Column:
            at = F.filter(F.transform(g, lambda x, i: F.when(x.isin(every), i + 1)), lambda i: i.isNotNull())
            return once(at, lambda known_at: F.flatten(F.transform(table, lambda t: of_template(t, g, known_at))))

        def better(o: Column, s: Column) -> Column:
            same = o["dice"] == s["dice"]
            rivals = (o["name"] != s["name"]) | (o["size"] == s["size"])
            return rivals & (o["a"] <= s["z"]) & (s["a"] <= o["z"]) & (
                (o["dice"] > s["dice"]) | (same & (o["name"] < s["name"])) | (same & (o["name"] == s["name"]) & ((o["a"] < s["a"]) | ((o["a"] == s["a"]) & (o["z"] < s["z"])))))

        best = once(once(grams, of_grams), lambda found: F.array_distinct(F.filter(found, lambda s: ~F.exists(found, lambda o: better(o, s)))))
        return F.transform(best, lambda s: F.struct(
            s["dice"].alias("dice"), s["name"].alias("name"), s["size"].alias("size"), s["a"].alias("a"), s["z"].alias("z"),
            F.array_distinct(F.transform(F.slice(tokens, s["a"], s["z"] - s["a"] + 2), lambda x: x["line"])).alias("lines")))

    def found(rest: Column) -> Column:
        tokens = lambda x: F.flatten(F.transform(x, lambda y, i: F.transform(words(y), lambda w: F.struct(w.alias("w"), i.alias("line")))))
        return once(rest, lambda x: F.when(F.arrays_overlap(words(F.array_join(x, " ")), rare), once(tokens(x), of_tokens)).otherwise(none))

    return found


_COMMON = frozenset("a and any are as at be by copy following for free from in is it may not of on or person program published terms that the this to under use version with without work you your 0 2 3 4".split())
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle_sql(threshold: float = THRESHOLD, templates=TEMPLATES) -> str:
    """The same for DuckDB: every line against every template, without size bounds."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(n)}, [{', '.join(map(quote, b))}])" for n, b in _templates(templates))
    return f"""
    with t(name, grams) as (values {rows}),
    l as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    e as (select r, line, generate_subscripts(lines, 1) as k, unnest(lines) as x from (select r, lines, null as line from l)),
    w as (select r, k, list_filter(string_split(regexp_replace(translate(x, '{_UP}', '{_LOW}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> '') as w from e),
    g as (select r, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) >= 2),
    s as (select r, k, name, 2.0::double * len(list_intersect(g, grams)) / (len(g) + len(grams)) as dice
          from g join t on list_has_any(g, grams)),
    h as (select r, k, name, dice, row_number() over (partition by r, k order by dice desc, name) as o from s where dice >= {threshold}),
    d as (select r, count(*) as n, string_agg(distinct name, ',' order by name) as names,
                 arg_min(name, (-dice, name)) as best_licence, max(dice) as best_dice from h where o = 1 group by r)
    select doc_id, len(lines)::bigint as n_lines, coalesce(n, 0)::bigint as n_licence_lines, coalesce(names, '') as licences, best_licence, best_dice
    from l left join d using (r)"""
