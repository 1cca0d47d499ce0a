"""Licence scan: a paragraph classifier on sparse word n-grams, confirmed by template comparison.

A multinomial logistic regression over word 1- to 3-grams (present or not) is trained on the
notices of each licence family and on paragraphs that grant none: talk about licences, loose
words of notices, and notices of versions that no family here has. Both kinds come in cut,
noised and embedded variants. Features are the n-grams that start within REACH words of an
anchor word; every notice has an anchor, so a paragraph without one is unknown, and anchors
serve as a lossless filter, one regular expression in the scan. Temperature and the bias of
the unknown class are calibrated on held-out variants, and nothing overrides them.

A predicted family stands only if the paragraph agrees with one of the family's templates:
enough of the template's word trigrams must be present (containment), each of its marks
(name with version, or a phrase that tells the family) must stand word for word, and a
template that is a bare title must be all there is. Else the paragraph stays unknown.

Paragraphs are the blocks of lines between blank lines or lines of comment marks only, so
wrapped notices are judged whole, and each line of a block, so a one-line notice inside a
block counts too; words are compared without marks, so comment signs do not matter.

Training runs on the driver over the tables below, which are constant. The main path is
DataFrame functions only: the n-grams around the anchors of candidate paragraphs are joined
with the broadcast weights (at most FEATURES rows), summed per paragraph as whole numbers by
a map-side combined aggregation, and reported per document.

The clause that the BSD licences share counts for the two-clause one where the document names
that and not the other, else for the three-clause one.

Defined cases: null and empty texts have no paragraphs and no licence; repeated rows are
judged alike; equal ids with different texts are judged apart; an empty table gives an
empty result; extra columns pass through scan_licenses, those named like an output column
are replaced; a very long paragraph is judged whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.store import keep, literal_table, quoted

FEATURES, PROBABILITY, CONTAINMENT, REACH, SEED = 20_000, 0.5, 0.6, 8, 3
UNKNOWN, SHARED = "unknown", "bsd"
#: Weights are whole numbers of this part.
PART = 10_000

#: How each family is called, with its version.
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "mit": ["MIT License", "MIT Licence"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GPLv2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3", "GPLv3"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "LGPLv2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU LGPL version 3", "LGPLv3"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU AGPL version 3", "AGPLv3"],
    "bsd-2-clause": ["BSD 2-Clause License", "Simplified BSD License", "two-clause BSD license"],
    "bsd-3-clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "three-clause BSD license"],
    "isc": ["ISC License"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
    "epl-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "unlicense": ["Unlicense"],
    "zlib": ["zlib License"],
    "cc0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"],
}
#: The parts of Creative Commons licences.
PARTS = {"by": "Attribution", "nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
for _kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"):
    _long = "-".join(PARTS[x] for x in _kind.split("-"))
    NAMES[f"cc-{_kind}-4.0"] = [f"CC {_kind.upper()} 4.0", f"Creative Commons {_long} 4.0 International", f"Creative Commons {_long} 4.0"]

#: Identifiers where they are not the family's name.
SPDX = {"mit": "MIT", "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense", **{f: f for f in NAMES if f not in ("mit", "isc", "zlib", "unlicense")}}

#: How a name is used to grant; each makes a template with the name as its mark.
FRAMES = ("under the {}", "under {}", "terms of the {}", "subject to the {}", "governed by the {}", "covered by the {}")

#: Passages of the licences themselves, with the phrases that tell them.
BODIES = {
    "apache-2.0": [
        ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', ["apache license version 2.0"]),
        ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
         "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ["on an as is basis", "or conditions of any kind"]),
    ],
    "mit": [
        ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
         "to deal in the Software without restriction.", ["to any person obtaining a copy of this software", "to deal in the software without restriction"]),
    ],
    "isc": [
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
         "copyright notice and this permission notice appear in all copies.", ["for any purpose with or without fee is hereby granted", "copyright notice and this permission notice appear"]),
    ],
    **{family: [
        ("This program is free software; you can redistribute it and/or modify it under the terms of the " + name + " as published by the Free Software Foundation; "
         "either version " + version + " of the License, or (at your option) any later version.", [" ".join(re.findall("[a-z]+", name.lower())), f"version {version} of the license"]),
    ] for family, name, version in (
        ("gpl-2.0", "GNU General Public License", "2"), ("gpl-3.0", "GNU General Public License", "3"), ("lgpl-2.1", "GNU Lesser General Public License", "2.1"),
        ("lgpl-3.0", "GNU Lesser General Public License", "3"), ("agpl-3.0", "GNU Affero General Public License", "3"))},
    SHARED: [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
         ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    ],
    "bsd-3-clause": [
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
         "without specific prior written permission.", ["to endorse or promote products derived from this software without specific prior written permission"]),
    ],
    "mpl-2.0": [
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
         "You can obtain one.", ["mozilla public license v 2.0"]),
    ],
    "unlicense": [
        ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
         ["free and unencumbered software released into the public domain"]),
    ],
    "zlib": [
        ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
         "subject to the following restrictions.", ["permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"]),
    ],
    "bsl-1.0": [
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.",
         ["to any person or organization obtaining a copy of the software"]),
    ],
    "cc0-1.0": [("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.", ["has waived all copyright and related or neighboring rights"])],
}

#: Paragraphs about licences and permission that grant none.
OTHERS = [
    "The driver lost his license after the accident.", "All rights reserved.", "Copyright holders may apply for a license at the office.",
    "He asked for permission to leave the room.", "The warranty of the machine is two years.", "A public hearing was held at the university.",
    "Apache helicopters flew over the valley.", "She studied at MIT for four years.", "Version 2.0 of the game was released in May.",
    "This work is under review by the general assembly.", "The license plate was found near the creative arts centre.",
    "You must not redistribute the notes without permission of the author.", "Mozilla released a new browser version 3.",
    "The commons voted on the attribution of the work.", "The following conditions are met by the public software market.",
    "A license to drive, fish or hunt is issued by the county for a small fee.", "The bar lost its liquor license under the new law.",
    "Our lawyers compare the MIT and Apache licenses in this article.", "Which license should I choose for my project?", "See the LICENSE file for details.",
    "This software is proprietary; no license is granted to use, copy or distribute it.", "Permission denied: you are not allowed to read this file.",
    "You should have received a copy of the license along with this program.", "The eclipse was seen by the public in version after version of the story.",
    "The software boost of the new release is version 1.0 of a long plan.", "Licensed taxis wait under the bridge.", "The GNU is an antelope of the general plains.",
    "Redistribution of land was permitted under the conditions of the treaty.", "Creative people share alike, and give attribution where it is due.",
    "Terms of service: you are granted a limited, personal, revocable license.", "The copyright notice shall be included in all copies.",
    "The BSD daemon is a mascot; the clause was struck from the contract.", "A patent license is subject to the terms of the agreement between the parties.",
    "This document is confidential and may not be distributed without permission.", "No warranties are given, express or implied.",
]

#: Every notice holds one of these words.
ANCHORS = (
    "license licensed licence licenses unlicense mit apache gnu gpl gplv2 gplv3 lgpl lgplv2.1 lgplv3 agpl agplv3 bsd mpl mozilla eclipse boost zlib isc creative "
    "commons cc cc0 spdx permission redistribution redistribute warranties clause noncommercial nc unencumbered contributors"
).split()

#: Blank lines between blocks, after line ends are made even and lines of comment marks only are made blank.
BLANK = r"\n(?:[ \t]*\n)+"
MARKS_ONLY = r"(?m)^[ \t]*(?:[#*;%>!-]+|//+|/\*+|\*+/)[ \t]*$"

_WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
WORD = r"[a-z0-9.]*[a-z0-9]"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def trigrams(ws: list[str]) -> list[str]:
    """None for fewer than three words: such a template is compared by its marks alone."""
    return sorted({" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)})


@lru_cache(maxsize=1)
def templates() -> dict[str, list[dict]]:
    """family -> templates: text, marks (phrases that must stand) and most (words of a paragraph, 0 for any number)."""
    out: dict[str, list[dict]] = {}
    for family, names in NAMES.items():
        mine = out.setdefault(family, [])
        for name in names:
            mark = [" ".join(words(name))]
            mine += [{"text": frame.format(name), "marks": mark, "most": 0} for frame in FRAMES]
            mine.append({"text": name, "marks": mark, "most": len(words(name)) + 3})
        mine.append({"text": f"SPDX-License-Identifier: {SPDX[family]}", "marks": [" ".join(words("identifier " + SPDX[family]))], "most": 12})
    for family, bodies in BODIES.items():
        out.setdefault(family, []).extend({"text": text, "marks": marks, "most": 0} for text, marks in bodies)
    return out


def other_versions() -> list[str]:
    """Names with versions that no family has."""
    own = {" ".join(words(n)) for names in NAMES.values() for n in names}
    out = []
    for names in NAMES.values():
        for name in names:
            number = re.search(r"[0-9](?:\.[0-9])?$|[0-9]\.[0-9]", name)
            for v in ("1", "1.1", "2.5", "3.0", "4", "5.0") if number else ():
                other = name[: number.start()] + v + name[number.end() :]
                if " ".join(words(other)) not in own and " ".join(words(other.replace(".0", ""))) not in own:
                    out.append(other)
    return out


def ngrams(ws: list[str]) -> set[str]:
    """Present 1- to 3-grams that start within REACH words of an anchor."""
    starts = {s for p, w in enumerate(ws) if w in _ANCHORS for s in range(max(0, p - REACH), min(len(ws), p + REACH + 1))}
    return {" ".join(ws[s : s + n]) for s in starts for n in (1, 2, 3) if s + n <= len(ws)}


_ANCHORS = frozenset(ANCHORS)


def _variants(text: str, rng, times: int, marks: list[str] = ()) -> list[list[str]]:
    """The text itself, and cut, noised and embedded copies, in which all marks still stand."""
    ws, fill = words(text), words(" ".join(OTHERS)) + [w * 2 for w in ("ab", "or", "th", "en")]
    some = lambda n: [fill[int(i)] for i in rng.integers(0, len(fill), n)]
    out = [ws]
    for _ in range(times):
        v = [w for w in ws if rng.random() > 0.04]
        v = v if all(f" {m} " in f" {' '.join(v)} " for m in marks) else ws
        out.append(some(int(rng.integers(0, 9))) + v + some(int(rng.integers(0, 9))))
    return out


def examples(seed: int = SEED) -> tuple[list[str], list[tuple[list[str], int]]]:
    """(families, the last unknown; (words, family) of all training variants)."""
    rng = np.random.default_rng(seed)
    families = [*templates(), UNKNOWN]
    none = len(families) - 1
    data: list[tuple[list[str], int]] = []
    for y, family in enumerate(templates()):
        for t in templates()[family]:
            opening = ("licensed", "released", "distributed", "available", "this work is licensed", "this project is released", "it is made available")
            frame = opening[int(rng.integers(0, len(opening)))] + " " if t["text"].startswith("under") else ""
            data += [(v, y) for v in _variants(frame + t["text"], rng, 12 if t["most"] or frame else 8, t["marks"])]
    for text in OTHERS:
        data += [(v, none) for v in _variants(text, rng, 12)]
    for name in other_versions():
        frame = FRAMES[int(rng.integers(0, len(FRAMES)))]
        data += [(v, none) for v in _variants("licensed " + frame.format(name), rng, 5)]
    parts = [w for ts in templates().values() for t in ts for w in words(t["text"])]
    for _ in range(600):  # loose words of licences in no order grant nothing
        data.append(([parts[int(i)] for i in rng.integers(0, len(parts), int(rng.integers(1, 14)))], none))
    return families, data


@lru_cache(maxsize=1)
def train(seed: int = SEED) -> tuple[list[str], list[tuple], list[float]]:
    """(families, last the unknown one; (n-gram, weights per family); intercepts), calibrated."""
    families, raw = examples(seed)
    data = [(ngrams(ws), y) for ws, y in raw]
    order = np.random.default_rng([seed, 1]).permutation(len(data))
    counts: dict = {}
    for grams, _ in data:
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
    vocabulary = sorted((g for g, n in counts.items() if n >= 4), key=lambda g: (-counts[g], g))[:FEATURES]
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(data), len(vocabulary) + 1), np.float32)
    y = np.array([t for _, t in data])
    for r, (grams, _) in enumerate(data):
        x[r, [place[g] for g in grams if g in place]] = 1
        x[r, -1] = 1
    fit, held = order[: len(order) * 4 // 5], order[len(order) * 4 // 5 :]
    w, speed = np.zeros((x.shape[1], len(families)), np.float32), 0.0
    mine, onehot = x[fit], np.eye(len(families), dtype=np.float32)[y[fit]]
    for _ in range(150):
        z = mine @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 1.0 * (mine.T @ (p - onehot) / np.float32(len(fit)) + np.float32(1e-4) * w)
        w = w + speed
    z = (x[held] @ w).astype(np.float64)
    best, best_loss = (1.0, 0.0), np.inf
    for t in np.linspace(0.4, 3.0, 27):
        for bias in np.linspace(-3, 3, 25):
            q = z * t
            q[:, -1] += bias
            q = q - q.max(1, keepdims=True)
            loss = -(q - np.log(np.exp(q).sum(1, keepdims=True)))[np.arange(len(held)), y[held]].mean()
            if loss < best_loss:
                best, best_loss = (float(t), float(bias)), loss
    w = w.astype(np.float64) * best[0]
    w[-1, -1] += best[1]
    whole = np.rint(w * PART).astype(int)
    return families, [(g, whole[i].tolist()) for g, i in place.items() if np.abs(whole[i]).max() > PART // 50], whole[-1].tolist()


def _word_array(text):
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _trigrams(ws: str):
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - 2, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, 3), " "))


def _anchored(ws: str):
    """The distinct 1- to 3-grams that start within REACH words of an anchor."""
    size = F.size(ws)
    places = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.get(ws, i).isin(*ANCHORS))
    starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(p - REACH, F.lit(0)), F.least(p + REACH, size - 1)))))

    def grams(s):
        return F.array(*[F.when(s + n <= size, F.array_join(F.slice(ws, s + 1, n), " ")) for n in (1, 2, 3)])

    return F.array_distinct(F.array_compact(F.flatten(F.transform(starts, grams))))


def _even(text):
    """Even line ends, and lines of comment marks only made blank."""
    return F.regexp_replace(F.regexp_replace(text, r"\R", "\n"), MARKS_ONLY, "")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t, para, p): the paragraphs that hold an anchor word, t a hash of the text: lines, then blocks of several lines."""
    body = F.coalesce(F.col(text), F.lit(""))
    gate = "(?i)(?<![a-z0-9])(?:" + "|".join(map(re.escape, ANCHORS)) + ")(?![a-z0-9])"
    even = docs.where(body.rlike(gate)).select(F.col(key).alias("id"), F.xxhash64(body).alias("t"), _even(body).alias("b"))
    blocks = F.transform(F.split("b", BLANK), lambda x: F.regexp_replace(x, "^\n|\n$", ""))
    blocks = F.filter(blocks, lambda x: F.contains(x, F.lit("\n")))
    rows = even.select("id", "t", F.posexplode(F.concat(F.split("b", "\n"), blocks)).alias("para", "p"))
    return rows.where(F.col("p").rlike(gate))


def classify(found: DataFrame) -> DataFrame:
    """found's (id, t, para, p) with family, probability (of that family) and containment; unknown ones too."""
    spark = found.sparkSession
    families, weights, intercept = train()
    table = literal_table(spark, weights, "gram string, w array<bigint>")  # at most FEATURES rows
    of_templates = sorted({g for ts in templates().values() for t in ts for g in trigrams(words(t["text"]))})
    # Of a paragraph only the n-grams near anchors, the trigrams that a template has, and the words for the marks are carried on.
    mine = F.array_distinct(F.filter(_trigrams("ws"), lambda g: g.isin(*of_templates)))
    joined = F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" "))
    anchored = found.select("id", "t", "para", _word_array(F.col("p")).alias("ws")).select("id", "t", "para", _anchored("ws").alias("a"), mine.alias("g"), joined.alias("s"), F.size("ws").alias("n"))
    anchored = keep(anchored.dropDuplicates(["id", "t", "para"]))
    each = anchored.select("id", "t", "para", F.explode("a").alias("gram"))
    met = each.join(F.broadcast(table), "gram")
    sums = met.groupBy("id", "t", "para").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(families))])
    logits = [(F.coalesce(F.col(f"s{i}"), F.lit(0)) + F.lit(b)) / F.lit(float(PART)) for i, b in enumerate(intercept)]
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("id", "t", "para")]
    sums = sums.withColumnsRenamed({c: f"_{c}" for c in ("id", "t", "para")})
    scored = anchored.join(sums, on[0] & on[1] & on[2], "left").select("id", "t", "para", "g", "s", "n", F.array(*logits).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("z")))
    best = scored.select("id", "t", "para", "g", "s", "n", (F.array_position("z", F.array_max("z")) - 1).cast("int").alias("c"), (F.lit(1.0) / total).alias("probability"))
    best = best.withColumn("family", F.get(F.array(*[F.lit(f) for f in families]), F.col("c")))
    shape = [
        (f, [{"grams": trigrams(words(t["text"])), "marks": [f" {m} " for m in t["marks"]], "most": t["most"]} for t in ts]) for f, ts in templates().items()
    ]
    known = literal_table(spark, shape, "family string, templates array<struct<grams:array<string>,marks:array<string>,most:int>>")
    with_t = best.join(F.broadcast(known), "family", "left")

    def share(t):
        stands = F.forall(t["marks"], lambda m: F.contains(F.col("s"), m)) & ((t["most"] == 0) | (F.col("n") <= t["most"]))
        return F.when(stands, F.coalesce(F.try_divide(F.size(F.array_intersect(t["grams"], F.col("g"))), F.size(t["grams"])), F.lit(1.0))).otherwise(0.0)

    judged = with_t.select("id", "t", "para", "family", "probability", F.coalesce(F.array_max(F.transform("templates", share)), F.lit(0.0)).alias("containment"))
    sure = (F.col("probability") >= PROBABILITY) & (F.col("containment") >= CONTAINMENT) & (F.col("family") != UNKNOWN)
    return judged.withColumn("family", F.when(sure, F.col("family")).otherwise(UNKNOWN))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of carry) with license (the surest paragraph's family or null), probability, containment,
    licenses (all families found, sorted), n_candidates (paragraphs with an anchor) and n_unknown of them."""
    made = ["license", "probability", "containment", "licenses", "n_candidates", "n_unknown"]
    cols = [c for c in (docs.columns if carry is None else carry) if c not in made]
    judged = classify(paragraphs(docs, key, text))
    known = F.col("family") != UNKNOWN
    ranked = F.when(known, F.struct("containment", "probability", (-F.col("para")).alias("at"), "family"))
    per_doc = judged.groupBy(F.col("id").alias("_k"), F.col("t").alias("_h")).agg(
        F.max(ranked).alias("_b"), F.collect_set(F.when(known, F.col("family"))).alias("_all"), F.count("*").alias("_n"), F.count_if(~known).alias("_u")
    )
    two = F.array_contains("_all", "bsd-2-clause") & ~F.array_contains("_all", "bsd-3-clause")
    named = lambda f: F.when(f != SHARED, f).when(two, "bsd-2-clause").otherwise("bsd-3-clause")
    per_doc = per_doc.withColumn("_family", F.when(F.col("_b").isNotNull(), named(F.col("_b.family")))).withColumn("_all", F.array_sort(F.array_distinct(F.transform("_all", named))))
    base = docs.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(cols)), F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    joined = base.join(per_doc, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_h")), "left")
    return joined.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(cols)),
        F.col("_family").alias("license"),
        F.round("_b.probability", 6).alias("probability"),
        F.round("_b.containment", 6).alias("containment"),
        F.coalesce("_all", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_candidates"),
        F.coalesce("_u", F.lit(0)).cast("bigint").alias("n_unknown"),
    )


def judge(text: str | None) -> tuple[str | None, list[str], int]:
    """The plain form of the scan for one text: (license, licenses, candidates). For tests."""
    families, weights, intercept = train()
    table = dict(weights)
    gate = re.compile(r"(?<![a-z0-9])(?:" + "|".join(map(re.escape, ANCHORS)) + r")(?![a-z0-9])", re.I)
    found, n = [], 0
    even = re.sub(MARKS_ONLY, "", re.sub(r"\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", "\n", text or ""))
    blocks = (re.sub(r"\A\n|\n\Z", "", b) for b in re.split(BLANK, even))
    for at, p in enumerate([*even.split("\n"), *(b for b in blocks if "\n" in b)]):
        if not gate.search(p):
            continue
        n += 1
        ws = words(p)
        z = np.array(intercept, float)
        for g in ngrams(ws):
            z = z + np.array(table.get(g, [0] * len(families)))
        z = z / PART
        chance = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family, s, mine = families[int(z.argmax())], f" {' '.join(ws)} ", set(trigrams(ws))
        share = 0.0
        for t in templates().get(family, ()):
            if all(f" {m} " in s for m in t["marks"]) and (not t["most"] or len(ws) <= t["most"]):
                grams = trigrams(words(t["text"]))
                share = max(share, sum(g in mine for g in grams) / len(grams) if grams else 1.0)
        if chance.max() >= PROBABILITY and share >= CONTAINMENT:
            found.append((share, chance.max(), -at, family))
    every = {f[3] for f in found}
    name = lambda f: f if f != SHARED else "bsd-2-clause" if "bsd-2-clause" in every and "bsd-3-clause" not in every else "bsd-3-clause"
    return (name(max(found)[3]) if found else None), sorted({name(f) for f in every}), n
