"""License scan: passages of a text compared to licence templates by Dice over word bigrams.

Words are runs of letters and digits in lower case. Three kinds of segment are compared: the whole text, each line,
and every window of as many words as the template has. The first two are sets of bigrams: Dice of a
and b items with c in common is 2c / (a + b), so a segment's size bounds what it can reach and few templates are left.
A window has the template's own length, so its Dice is the share of the template's bigrams (each as often as it stands
there) that it holds.

Licences with nearly the same words are told apart by telling words. Two templates of different licences
are siblings from Dice SIBLINGS on; a segment matches a template only if it holds every word of it that a
sibling's licence never uses, and none of a sibling's that its own licence never uses. It must also hold the template's
anchor, one of ANCHORS, so a text without any of these is not read further. Where licences share a whole passage, a match
inside a longer match of another licence is part of that one and is not listed.

Windows are not compared one by one. A bigram of the template counts for a range of window starts; the
ends of all ranges, sorted, give the count at every start as a running sum, so the work grows with the hits
and not with their pairs. Starts that match in a row are one passage, placed where it is best.

Only DataFrame functions: texts with an anchor are cut into word rows and joined to two tables of fixed
size. Equal texts are scanned once. Defined results: null and wordless texts match nothing; equal scores go to
the first licence in order; repeated rows and null ids get a row each; an empty table gives an empty one;
further columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetshape.llm.frames import stored

THRESHOLD = 0.8
#: Dice from which templates of two licences are siblings.
SIBLINGS = 0.5
#: Words of which every template has one, the first that it has being its anchor.
ANCHORS = ("license", "licensed", "licenses", "permission", "redistribution", "warranty")
#: Words too common to tell licences apart.
COMMON = frozenset("a an and any as at by for in is it of or the this to under with".split())
#: A template's bigram may stand in it this often.
MOST_REPEATS = 8

#: How licences are called in notices.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",), "Apache-1.1": ("the Apache Software License, Version 1.1",),
    "Apache-2.0": ("the Apache License, Version 2.0",), "Artistic-2.0": ("the Artistic License 2.0",),
    "BSD-2-Clause": ("the BSD 2-Clause License",), "BSD-3-Clause": ("the BSD 3-Clause License",), "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-3.0": ("CC BY 3.0", "a Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "EPL-2.0": ("the Eclipse Public License 2.0",), "GPL-1.0": ("the GNU General Public License, version 1",), "GPL-2.0": ("the GNU General Public License, version 2",),
    "GPL-3.0": ("the GNU General Public License, version 3",), "ISC": ("the ISC License",), "LGPL-2.0": ("the GNU Library General Public License, version 2",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",), "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "MIT": ("the MIT License",), "MIT-0": ("the MIT No Attribution License",), "MPL-1.1": ("the Mozilla Public License, version 1.1",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",), "Zlib": ("the zlib License",),
}
#: What stands before a name.
OPENINGS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.")

_FSF = ("This program is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; "
        "either version {} of the License, or (at your option) any later version.")
_CC = ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
       "Creative Commons {} 4.0 International Public License")
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."

#: Passages of notices and licence texts.
PASSAGES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", _FSF.format("GNU Affero General Public License", 3)),
    ("AGPL-3.0", f"GNU Affero General Public License Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and Conditions for Use, Reproduction, and Distribution"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("CC-BY-4.0", _CC.format("Attribution")), ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial")),
    ("CC-BY-NC-ND-4.0", _CC.format("Attribution-NonCommercial-NoDerivatives")), ("CC-BY-NC-SA-4.0", _CC.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-ND-4.0", _CC.format("Attribution-NoDerivatives")), ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike")),
    ("GPL-1.0", _FSF.format("GNU General Public License", 1)), ("GPL-2.0", _FSF.format("GNU General Public License", 2)),
    ("GPL-2.0", f"GNU General Public License Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-3.0", _FSF.format("GNU General Public License", 3)),
    ("GPL-3.0", f"GNU General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-2.0", _FSF.format("GNU Library General Public License", 2)), ("LGPL-2.1", _FSF.format("GNU Lesser General Public License", "2.1")),
    ("LGPL-3.0", _FSF.format("GNU Lesser General Public License", 3)),
    ("LGPL-3.0", f"GNU Lesser General Public License Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
            "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
            "in the Software without restriction."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
              "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
              "the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY"),
    ("MPL-2.0", _MPL),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, "
                "contributes to the creation of, or owns Covered Software."),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


#: Notices, as far as they have an anchor, and passages.
TEMPLATES: tuple[tuple[str, str], ...] = (
    *[(name, o.format(n)) for name, called in NAMES.items() for n in called for o in OPENINGS if set(words_of(o.format(n))) & set(ANCHORS)], *PASSAGES)


def bigrams_of(words: list[str]) -> list[str]:
    return [" ".join(p) for p in zip(words, words[1:])]


def dice(a: set, b: set) -> float:
    return 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass(frozen=True)
class Template:
    """A template with what its matches have to hold (`needed`) and must not (`barred`)."""

    no: int
    license: str
    grams: Counter
    needed: frozenset
    barred: frozenset

    @property
    def length(self) -> int:
        return sum(self.grams.values())


def prepared(templates=TEMPLATES) -> list[Template]:
    split = [(name, words_of(text)) for name, text in templates]
    used: dict[str, set] = {}
    for name, words in split:
        used.setdefault(name, set()).update(words)
    out = []
    for no, (name, words) in enumerate(split):
        grams = Counter(bigrams_of(words))
        if not grams or max(grams.values()) > MOST_REPEATS or not set(words) & set(ANCHORS):
            raise ValueError(f"template {no} of {name}: two words, an anchor and no bigram more than {MOST_REPEATS} times are needed")
        needed, barred = {next(a for a in ANCHORS if a in words)}, set()
        for other, theirs in split:
            if other != name and dice(set(grams), set(bigrams_of(theirs))) >= SIBLINGS:
                needed |= set(words) - used[other] - COMMON
                barred |= set(theirs) - used[name] - COMMON
        out.append(Template(no, name, grams, frozenset(needed), frozenset(barred)))
    return out


def normalised(text: Column) -> Column:
    """Lower case, line breaks kept, everything else that is no letter or digit one blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


KEY = ["k1", "k2"]


def _tokens(texts: DataFrame) -> DataFrame:
    """The columns of `texts` but its text t, pos (from 1), w, line, gram (with the next word, null at the end), same_line (both words on it): a row per word."""
    rest = [c for c in texts.columns if c != "t"]
    words = F.flatten(F.transform(F.split(normalised(F.col("t")), "\n"), lambda s, i: F.transform(
        F.filter(F.split(s, " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    listed = texts.select(*rest, words.alias("a"))
    # The last word has no next one: zip_with fills the shorter side with null.
    after = F.when(F.size("a") > 1, F.slice("a", F.lit(2), F.size("a") - 1)).otherwise(F.array().cast("array<struct<w: string, line: int>>"))
    pairs = F.zip_with("a", after, lambda x, y: F.struct(
        x["w"].alias("w"), x["line"].alias("line"), F.when(y.isNotNull(), F.concat_ws(" ", x["w"], y["w"])).alias("gram"),
        F.coalesce(x["line"] == y["line"], F.lit(False)).alias("same_line")))
    return listed.select(*rest, F.posexplode(pairs).alias("p", "x")).select(*rest, (F.col("p") + 1).alias("pos"), "x.*")


def _gram_table(spark, known: list[Template]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(t.no, g, m, t.length) for t in known for g, m in t.grams.items()], "no int, item string, times int, length int"))


def _able(texts: DataFrame, known: list[Template], facts: DataFrame, threshold: float) -> DataFrame:
    """k1, k2, nos: templates of which a text holds enough bigrams at all. All that is shuffled is how often a bigram of any template stands in a text."""
    spark = texts.sparkSession
    any_of = F.broadcast(spark.createDataFrame([(g,) for g in sorted({g for t in known for g in t.grams})], "gram string"))
    counted = _tokens(texts).join(any_of, "gram", "left_semi").groupBy(*KEY, "gram").agg(F.count(F.lit(1)).alias("n"))
    held = counted.join(_gram_table(spark, known), F.col("gram") == F.col("item")).groupBy(*KEY, "no").agg(
        F.sum(F.least("n", "times")).alias("held"), F.count(F.lit(1)).alias("c")).join(facts, "no")
    enough = (F.col("held") >= threshold * F.col("length")) | (2.0 * F.col("c") / (F.col("c") + F.col("n_set")) >= threshold)
    return held.where(enough).groupBy(*KEY).agg(F.collect_list("no").alias("nos"))


def _hits(tokens: DataFrame, known: list[Template]) -> DataFrame:
    """k1, k2, no, kind (g, n or b), item, times, length, pos, line: where bigrams, needed and barred words of the templates `nos` stand."""
    spark = tokens.sparkSession
    grams = _gram_table(spark, known)
    words = spark.createDataFrame([(t.no, kind, w, 1, t.length) for t in known for kind, ws in (("n", t.needed), ("b", t.barred)) for w in sorted(ws)],
                                  "no int, kind string, item string, times int, length int")
    line = F.when(F.col("same_line"), F.col("line"))
    able = F.array_contains("nos", F.col("no"))
    by_gram = tokens.join(grams, tokens["gram"] == grams["item"]).where(able).select(
        *KEY, "no", F.lit("g").alias("kind"), "item", "times", "length", "pos", line.alias("line"))
    by_word = tokens.join(F.broadcast(words), tokens["w"] == words["item"]).where(able).select(*KEY, "no", "kind", "item", "times", "length", "pos", "line")
    return by_gram.unionByName(by_word)


def _facts(known: list[Template], spark) -> DataFrame:
    rows = [(t.no, t.license, len(t.grams), t.length, len(t.needed)) for t in known]
    return F.broadcast(spark.createDataFrame(rows, "no int, license string, n_set int, length int, n_needed int"))


def _grams_of(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))


def _sizes(texts: DataFrame) -> DataFrame:
    """k1, k2, sizes (different bigrams), counts (words): of the whole text, then of each line. Rows stay rows."""
    lines = F.transform(F.split(normalised(F.col("t")), "\n"), lambda s: F.filter(F.split(s, " "), lambda w: w != ""))
    held = texts.select(*KEY, lines.alias("lines")).select(*KEY, F.concat(F.array(F.flatten("lines")), F.col("lines")).alias("parts"))
    return held.select(*KEY, F.transform("parts", lambda w: F.size(F.array_distinct(_grams_of(w)))).alias("sizes"), F.transform("parts", F.size).alias("counts"))


def _segments(texts: DataFrame, hits: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """Matches of whole texts and lines: k1, k2, no, license, segment (0 or the line), first_word, last_word, dice."""
    each = hits.withColumn("segment", F.explode(F.array_compact(F.array(F.lit(0), "line"))))
    counted = each.groupBy(*KEY, "segment", "no").agg(
        F.count_distinct(F.when(F.col("kind") == "g", F.col("item"))).alias("c"),
        F.count_distinct(F.when(F.col("kind") == "n", F.col("item"))).alias("held"), F.count_if(F.col("kind") == "b").alias("barred"))
    # Fewer than this in common reach the threshold with no segment, as it has at least as many bigrams itself.
    able = stored(counted.join(facts, "no").where((F.col("held") == F.col("n_needed")) & (F.col("barred") == 0) & (
        2.0 * F.col("c") / (F.col("c") + F.col("n_set")) >= threshold)), "segments")
    sized = able.join(_sizes(texts.join(able.select(*KEY).distinct(), KEY, "left_semi")), KEY)
    before = F.aggregate(F.slice("counts", F.lit(2), F.greatest(F.col("segment") - 1, F.lit(0))), F.lit(0), lambda a, n: a + n)
    scored = sized.withColumns({
        "dice": 2.0 * F.col("c") / (F.element_at("sizes", F.col("segment") + 1) + F.col("n_set")), "first_word": before + 1,
        "last_word": before + F.element_at("counts", F.col("segment") + 1)})
    return scored.where(F.col("dice") >= threshold).select(*KEY, "no", "license", "segment", "first_word", "last_word", "dice")


def _windows(hits: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """Passages: k1, k2, no, license, first_word, last_word, dice of the best window of each row of matching starts."""
    one = W.partitionBy(*KEY, "no", "kind", "item").orderBy("pos")
    before = reduce(lambda c, m: c.when(F.col("times") == m, F.lag("pos", m).over(one)), range(1, MOST_REPEATS + 1), F)
    # A window that starts at s has the bigrams s to s + length - 1 and the words s to s + length.
    reach = F.col("length") - F.when(F.col("kind") == "g", 1).otherwise(0)
    since = F.greatest(F.lit(1), F.col("pos") - reach, F.when(F.col("kind") != "b", F.coalesce(before, F.lit(0)) + 1).otherwise(1))
    ranged = hits.withColumn("since", since)
    ends = ranged.select(*KEY, "no", "kind", F.explode(F.array(F.struct(F.col("since").alias("s"), F.lit(1).alias("d")), F.struct(
        (F.col("pos") + 1).alias("s"), F.lit(-1).alias("d")))).alias("e")).select(*KEY, "no", "kind", "e.*")
    steps = ends.groupBy(*KEY, "no", "s").agg(*[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(k) for k in "gnb"])
    along = W.partitionBy(*KEY, "no").orderBy("s")
    upto = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    state = steps.select(*KEY, "no", "s", *[F.sum(k).over(upto).alias(k) for k in "gnb"], (F.lead("s").over(along) - 1).alias("until"))
    fits = state.join(facts, "no").where(
        (F.col("n") == F.col("n_needed")) & (F.col("b") == 0) & (F.col("g") / F.col("length") >= threshold))
    last = F.max("until").over(along.rowsBetween(W.unboundedPreceding, -1))
    begun = fits.withColumn("begins", F.when(F.col("s") > F.coalesce(last, F.lit(-1)) + 1, 1).otherwise(0))
    rows = begun.withColumn("row", F.sum("begins").over(upto))
    best = rows.groupBy(*KEY, "no", "license", "length", "row").agg(F.min(F.struct((-F.col("g")).alias("g"), "s")).alias("m"))
    return best.select(*KEY, "no", "license", F.lit(None).cast("int").alias("segment"), F.col("m.s").alias("first_word"),
                       (F.col("m.s") + F.col("length")).alias("last_word"), (-F.col("m.g") / F.col("length")).alias("dice"))


def _outermost(matches: Column) -> Column:
    """Matches that do not lie inside a longer one of another licence."""
    size = lambda m: m["last_word"] - m["first_word"]
    return F.filter(matches, lambda m: ~F.exists(matches, lambda o: (o["license"] != m["license"]) & (
        o["first_word"] <= m["first_word"]) & (o["last_word"] >= m["last_word"]) & (size(o) > size(m))))


_MATCH = ("no", "license", "segment", "first_word", "last_word", "dice")


def scan(df: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, matches (no, license, segment, first_word, last_word, dice), license, dice (of the best).

    `no` is the template's place; `segment` is 0 for the whole text, the number of a line, or null for a passage, whatever
    its lines. Words and lines count from 1. A window may end beyond the last word.
    """
    known = prepared(templates)
    low = F.lower(df[text])
    anchored = reduce(or_, (F.contains(low, F.lit(a)) for a in ("licens", *[a for a in ANCHORS if not a.startswith("licens")])))
    own = F.when(anchored, df[text])
    # Two hashes, so that different texts do not meet in one key.
    base = stored(df.select("doc_id", own.alias("t"), F.xxhash64(own).alias("k1"), F.xxhash64(F.lit(1), own).alias("k2")), "anchored")
    facts = _facts(known, df.sparkSession)
    texts = base.where("t is not null").select("t", *KEY).dropDuplicates(KEY)
    # Cut into words twice: once for the templates a text may match, and then, for nearly all none, for where these stand.
    texts = stored(texts.join(_able(texts, known, facts, threshold), KEY), "able")
    hits = stored(_hits(_tokens(texts), known), "hits")
    matched = _segments(texts, hits, facts, threshold).unionByName(_windows(hits, facts, threshold))
    # All matches of one text: templates times its lines and passages at most.
    found = matched.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*_MATCH))).alias("matches"))
    found = found.withColumn("matches", _outermost(F.col("matches")))
    # Texts without an anchor do not take part in the join: they would all share the key of null.
    read = base.where("t is not null").select("doc_id", *KEY).join(found, KEY, "left").drop(*KEY)
    kind = found.schema["matches"].dataType
    every = read.unionByName(base.where("t is null").select("doc_id", F.lit(None).cast(kind).alias("matches")))
    every = every.select("doc_id", F.coalesce("matches", F.array().cast(kind)).alias("matches"))
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("less"), m["license"].alias("license"))))
    return every.withColumns({"license": best["license"], "dice": -best["less"]})
