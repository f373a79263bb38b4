"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

Paragraphs are parted by blank lines; a paragraph's words run on over its line ends. A logistic regression for each licence family, and one
for `licence of any kind`, scores windows of `window` words by their distinct 1-grams and 2-grams. Weights are sparse, fitted on
the driver from the notices below, set in ordinary words; a temperature and a limit for each are calibrated on other notices, among them
licences of no family. A window names every family that reaches its limit, so a paragraph can have several; where some window is a
licence and no window names a family, the paragraph's class is `unknown`. A prediction is confirmed if most 3-grams of a
template of that family are in the words around the window.

Every paragraph is scored. One pass over its n-grams adds up, window by window, the most that any class can get; a window whose sum stays under what
every class lacks is no licence for certain, and only the others are scored class by class. Grams of function words, digits and
letters alone may only speak against a class.

Scoring is a projection: n-grams, weights and templates are literals of the plan, bounded by `Options.features`. Only the windows
that are a licence are shuffled, by document and paragraph.

Defined results: a null or empty text has no paragraphs and no licence. Repeated rows are scanned alike, a row each. A very long text
is one row for the JVM and its windows are made only in paragraphs that may hold a licence. Ties: families are named in the
order of their names. An empty table gives an empty table. Other columns are ignored. A null doc_id stays null.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import frames
from tidemark.llm.quality_rules import COMMON

#: Notices by licence family, as projects commonly write them. These are learnt and are the templates.
NOTICES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "licensed under the AGPLv3"
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license", "dual licensed under Apache-2.0 and another license",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Apache-2.0"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License", "Released under the BSD license", "SPDX-License-Identifier: BSD-2-Clause",
        "BSD-style license that can be found in the LICENSE file", "new BSD license"
    ),
    "BSL": (
        "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt", "Licensed under the Boost Software License"
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Content is available under CC BY", "Creative Commons Attribution license"
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Content is available under CC BY-NC", "Creative Commons noncommercial license"
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Text is available under the Creative Commons Attribution-ShareAlike License", "Content is available under CC BY-SA"
    ),
    "EPL": (
        "This program is made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Eclipse Public License v 2.0", "which is available at https://www.eclipse.org/legal/epl-2.0"
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPLv3", "Licensed under the GPL version 2",
        "This program is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPLv2", "released under the GPL"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License", "SPDX-License-Identifier: ISC", "Released under the ISC license"
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU Lesser General Public License version 2.1", "Released under the LGPL", "GNU Library General Public License",
        "licensed under the LGPLv3"
    ),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license", "This project is MIT licensed",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT", "Distributed under the terms of the MIT License", "the MIT license", "licensed under MIT",
        "MIT or Apache", "dual licensed under MIT and another license"
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License 2.0", "Released under the MPL 2.0"
    ),
    "Public-Domain": (
        "This work is dedicated to the public domain under CC0 1.0",
        "This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: CC0-1.0",
        "Released under the Unlicense", "No rights reserved, public domain dedication"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty", "Licensed under the zlib License",
        "SPDX-License-Identifier: Zlib",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"
    ),
}
#: Licences of no family above: what `unknown` is learnt from.
UNKNOWN = (
    "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited",
    "All rights reserved. No part of this publication may be reproduced without permission",
    "Licensed under the terms of the European Union Public Licence", "Distributed under the Artistic License 2.0",
    "Proprietary. Do not distribute.", "This software is licensed, not sold, under the end user license agreement",
    "SPDX-License-Identifier: CDDL-1.0", "Use of this software is subject to the license terms of the vendor",
    "Licensed under the Microsoft Public License", "Copyright by the authors, all rights reserved",
)
#: Other wordings, for calibration only.
HELD: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "This service is free software under the terms of the GNU Affero General Public License version 3 or later",
        "covered by the AGPL version 3 license"
    ),
    "Apache": (
        "This product is licensed under Apache License 2.0", "The code is available under the Apache License version 2.0",
        "see the Apache 2.0 licence for details"
    ),
    "BSD": (
        "This package is distributed under the terms of the BSD license",
        "Redistribution in source and binary forms with or without modification is permitted under the BSD 2-Clause License"
    ),
    "BSL": ("Use, modification and distribution are subject to the Boost Software License version 1.0",),
    "CC-BY": ("All articles are published under a Creative Commons Attribution 4.0 license", "Shared under the CC BY 4.0 licence"),
    "CC-BY-NC": ("Shared under the Creative Commons Attribution-NonCommercial 4.0 license", "Images are CC BY-NC 4.0"),
    "CC-BY-SA": (
        "Shared under the Creative Commons Attribution-ShareAlike 4.0 license", "Articles are available under the CC BY-SA 4.0 license"
    ),
    "EPL": ("All content is made available under the Eclipse Public License version 2.0",),
    "GPL": (
        "You can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This package is distributed under the GNU GPL version 3", "free software under the GPL version 2 or later"
    ),
    "ISC": (
        "This package is available under the ISC license",
        "Permission to use, copy, modify and distribute this software for any purpose is hereby granted"
    ),
    "LGPL": (
        "You can redistribute this library under the terms of the GNU Lesser General Public License", "available under the LGPL version 2.1"
    ),
    "MIT": (
        "This software is distributed under the MIT License", "The source code is licensed under MIT",
        "available under the MIT license, see below"
    ),
    "MPL": ("This file is covered by the Mozilla Public License version 2.0", "distributed under the Mozilla Public License"),
    "Public-Domain": (
        "The author has dedicated this work to the public domain with CC0", "This file has been released into the public domain"
    ),
    "Zlib": ("This library is distributed under the zlib license",),
}
HELD_UNKNOWN = (
    "Licensed under the SIL Open Font License, Version 1.1",
    "This file is confidential and proprietary, unauthorized copying is prohibited",
    "Distributed under the Do What You Want public license", "all rights reserved, no part may be copied",
    "Your use is subject to the license agreement"
)
#: Sentences that share words with notices but are none.
OTHERS = (
    "The driver must renew his license every ten years", "The public was in general agreement with the foundation",
    "See the terms and conditions of this site", "Version 2.0 was released under budget",
    "a free copy of the work is available at the library",
    "The software is used in source and binary systems", "Fishing licenses are sold at the office", "Licensed premises close at ten",
    "This article is about the free software movement", "the general public may use the library",
    "Permission was granted to any person in the hall",
    "You may use this file", "the foundation published a lesser known work", "creative work in the commons", "The license plate was found",
    "an attribution error in the article", "This program is for the public", "MIT researchers published a paper",
    "The apache people live in the southwest",
    "the eclipse was seen in public", "a boost in sales of the new version", "the domain of the function is public knowledge",
    "the mozilla browser was released", "the purpose of this software is to copy and distribute files",
    "a copyright dispute between authors", "published under the name of the author",
    "all rights of the people are reserved by law", "the vendor made a proprietary offer", "no part of the building may be used",
    "subject to the weather", "available at the end of the year under new terms", "the terms of the agreement were subject to review",
)
ANY = "any"


@dataclass(frozen=True)
class Options:
    features: int = 900
    l1: float = 1e-4
    rounds: int = 250
    window: int = 24
    stride: int = 8
    context: int = 64  # words around a window's begin that templates are looked for in
    confirm: float = 0.6
    seed: int = 5


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _grams(words: list[str], sizes=(1, 2)) -> set[str]:
    return {" ".join(words[i : i + k]) for k in sizes for i in range(len(words) - k + 1)}


@dataclass
class Model:
    families: list[str]  # the last is ANY
    weights: dict[str, list[float]]
    bias: list[float]
    limits: list[float]
    opt: Options
    templates: dict[str, list[list[str]]] = field(default_factory=dict)

    def positive(self) -> list[str]:
        """The grams that speak for some class."""
        return [g for g, w in self.weights.items() if max(w) > 0]

    def scores(self, words: list[str]) -> np.ndarray:
        """The probability of each class for one window."""
        z = np.array(self.bias) + sum(
            (np.array(self.weights[g]) for g in sorted(_grams(words)) if g in self.weights), np.zeros(len(self.bias))
        )
        return 1 / (1 + np.exp(-z))

    def paragraph(self, text: str) -> dict[str, float]:
        """The families of a paragraph with their greatest probabilities, window by window: what the DataFrame computes."""
        words, best = _words(text), np.zeros(len(self.families))
        for at in range(0, max(1, len(words)), self.opt.stride):
            if at and at + self.opt.window - self.opt.stride >= len(words):
                break
            best = np.maximum(best, self.scores(words[at : at + self.opt.window]))
        found = {f: float(p) for f, p, t in zip(self.families[:-1], best, self.limits, strict=False) if p >= t}
        if not found and best[-1] >= self.limits[-1]:
            return {"unknown": float(best[-1])}
        return found


def _examples(
    notices: dict[str, tuple[str, ...]], unknown: tuple[str, ...], n: int, rng: np.random.Generator, window: int
) -> tuple[list[set[str]], np.ndarray]:
    """Windows of notices in ordinary words, whole or cut, some of two families; and windows of ordinary words alone."""
    families = list(NOTICES)
    plain = [w for ws in COMMON.values() for w in ws if w.isascii()]
    filler = [*plain, *(w for t in OTHERS for w in _words(t))]
    rows, labels = [], []

    def ordinary(k: int) -> list[str]:
        if rng.random() < 0.5:
            return [str(x) for x in rng.choice(plain, k)]
        out: list[str] = []
        while len(out) < k:
            out += _words(OTHERS[int(rng.integers(len(OTHERS)))]) if rng.random() < 0.7 else [str(x) for x in rng.choice(filler, 4)]
        return out[:k]

    def add(parts: list[list[str]], who: list[str]) -> None:
        room = max(0, window - sum(map(len, parts)))
        k = int(rng.integers(0, room + 1)) if rng.random() < 0.8 else 0
        cut = int(rng.integers(0, k + 1))
        body = [w for p in parts for w in p]
        rows.append(_grams([*ordinary(cut), *body, *ordinary(k - cut)][: window + 8]))
        labels.append([f in who for f in families] + [bool(who)])

    for f, ts in [*notices.items(), (ANY, unknown)]:
        for t in ts:
            w = _words(t)
            for i in range(n):
                keep = len(w) if i % 2 == 0 or len(w) < 5 else int(len(w) * rng.uniform(0.75, 1))
                at = int(rng.integers(0, len(w) - keep + 1))
                add([w[at : at + keep][:window]], [f])
            if f != ANY:
                for _ in range(max(1, n // 4)):
                    g = families[int(rng.integers(len(families)))]
                    o = _words(notices[g][int(rng.integers(len(notices[g])))])
                    add([w[: window // 2], [str(rng.choice(["and", "or"]))], o[: window // 2]], [f, g])
    for _ in range(60 * n):
        rows.append(_grams(ordinary(int(rng.integers(3, window + 1)))))
        labels.append([False] * (len(families) + 1))
    return rows, np.array(labels, dtype=np.float32)


def train(opt: Options = Options()) -> Model:
    """One logistic regression a class by proximal gradient steps (L1), then a temperature and limits on the held notices."""
    rng = np.random.default_rng(opt.seed)
    families = [*NOTICES, ANY]
    rows, y = _examples(NOTICES, UNKNOWN, 16, rng, opt.window)
    count: dict[str, int] = {}
    for g in rows:
        for x in g:
            count[x] = count.get(x, 0) + 1
    vocab = [g for g, n in sorted(count.items(), key=lambda x: (-x[1], x[0])) if n >= 6][: 2 * opt.features]
    index = {g: i for i, g in enumerate(vocab)}

    def matrix(rows: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(rows), len(vocab)), dtype=np.float32)
        for i, g in enumerate(rows):
            x[i, [index[v] for v in g if v in index]] = 1
        return x

    x = matrix(rows)
    share = y.mean(0)
    importance = np.where(y > 0, 0.5 / np.maximum(share, 1e-3) ** 0.5, 0.5)  # rare classes weigh more
    plain = {w for ws in COMMON.values() for w in ws}
    against = np.array(
        [all(v in plain or v.isdigit() or len(v) == 1 for v in g.split()) for g in vocab]
    )  # such grams may only speak against a licence
    w, b, velocity = np.zeros(
        (len(vocab), len(families)), np.float32
    ), np.full(len(families), -2.0, np.float32), np.zeros((len(vocab), len(families)), np.float32)
    for _ in range(opt.rounds):
        g = (1 / (1 + np.exp(-(x @ w + b))) - y) * importance / len(y)
        velocity = 0.9 * velocity - 1.5 * (x.T @ g)
        w = w + velocity
        w = np.sign(w) * np.maximum(np.abs(w) - 4 * opt.l1, 0)
        w[against] = np.minimum(w[against], 0)
        b = np.minimum(b - 4 * g.sum(0), -1.5)  # a window without any gram is no licence
    strongest = np.argsort(-np.abs(w).max(1), kind="stable")[: opt.features]
    drop = np.ones(len(vocab), bool)
    drop[strongest] = False
    w[drop] = 0
    held, truth = _examples(HELD, HELD_UNKNOWN, 6, rng, opt.window)
    z = matrix(held) @ w + b

    def loss(t: float) -> float:
        p = np.clip(1 / (1 + np.exp(-z / t)), 1e-9, 1 - 1e-9)
        return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

    t = min(np.geomspace(0.25, 4, 40), key=loss)
    p = 1 / (1 + np.exp(-z / t))
    limits = []
    for k in range(len(families)):
        right = [c for c in np.linspace(0.5, 0.95, 46) if not (p[:, k] >= c).any() or truth[p[:, k] >= c, k].mean() >= 0.98]
        limits.append(round(float(right[0] if right else 0.95), 4))
    weights = {vocab[i]: [round(float(v) / t, 4) for v in w[i]] for i in range(len(vocab)) if np.abs(w[i]).max() > 1e-3}
    templates = {f: [sorted(_grams(_words(s), (min(3, len(_words(s))),))) for s in ts] for f, ts in NOTICES.items()}
    return Model(families, weights, [round(float(v) / t, 4) for v in b], limits, opt, templates)


def _constant(value, kind: str) -> Column:
    """A table of the plan. As one JSON literal it is one node, which the optimiser folds into a value."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _lookup(d: dict, kind: str, parts: int = 64):
    """A function from a gram to its value in a table of the plan. Maps are searched from end to end, so the table is cut by a hash of the gram."""
    cut: list[dict] = [{} for _ in range(parts)]
    for k, v in d.items():
        cut[zlib.crc32(k.encode()) % parts][k] = v
    maps = _constant(cut, f"array<map<string,{kind}>>")
    return lambda g: F.element_at(F.get(maps, (F.crc32(g.cast("binary")) % parts).cast("int")), g)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def _pairs(words: Column, n: int = 2) -> Column:
    """The n-grams of an array of words."""
    none = F.expr("cast(array() as array<string>)")
    return F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    ).otherwise(none)


def _bounds(words: Column, model: Model) -> Column:
    """For each word the most that the 1-gram and the 2-gram that begin there can add to a class's score."""
    highest = {g: max(w) for g, w in model.weights.items() if max(w) > 0}
    ones, twos = ({g: v for g, v in highest.items() if (" " in g) == two} for two in (False, True))
    first = sorted({g.split()[0] for g in twos})

    def most(g: Column, known: dict[str, float]) -> Column:
        return F.when(g.isin(list(known)), _lookup(known, "double")(g)).otherwise(F.lit(0.0)) if known else F.lit(0.0)

    pair = lambda a, b: F.when(
        a.isin(first), F.coalesce(most(F.concat(a, F.lit(" "), b), twos), F.lit(0.0))
    ).otherwise(F.lit(0.0)) if first else F.lit(0.0)
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: most(a, ones) + pair(a, b))


def windows(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph (1 first), own, near): the windows that may be a licence, each with its words and those around its begin.

    A row has the words of one window only, so a paragraph of very many licences is not copied for each.
    """
    opt = model.opt
    blocks = F.transform(
        F.split("text", r"\n[ \t\r]*\n"), lambda t,
        i: F.struct((i + 1).alias("paragraph"), F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    )
    each = docs.select("doc_id", F.explode(blocks).alias("p")).select("doc_id", "p.paragraph", "p.words")
    need = min(float(np.log(t / (1 - t))) - b for t, b in zip(model.limits, model.bias, strict=True)) - 1e-6
    half = (opt.context - opt.window) // 2
    last = F.greatest(F.size("words") - opt.window + opt.stride - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last - last % opt.stride, F.lit(opt.stride))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v)
    able = F.filter(starts, lambda at: total(F.slice("most", at + 1, opt.window)) >= need)  # at others no class can reach its limit
    some = each.select(
        "doc_id", "paragraph", "words", F.explode(F.array(_bounds(F.col("words"), model))).alias("most")
    ).where(total("most") >= need)
    each = F.transform(
        able, lambda at: F.struct(
            F.slice("words", at + 1, opt.window).alias("own"),
            F.slice("words", F.greatest(at + 1 - half, F.lit(1)), opt.context).alias("near")
        )
    )
    return some.select("doc_id", "paragraph", F.explode(each).alias("w")).select("doc_id", "paragraph", "w.own", "w.near")


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, paragraph (1 first), family, probability, confirmed): a row for each family of each window that is a licence."""
    opt = model.opt
    weights, bias = _lookup(model.weights, "array<double>"), _constant(model.bias, "array<double>")
    templates = _constant(model.templates, "map<string,array<array<string>>>")
    own = F.col("own")
    grams = F.array_distinct(F.filter(F.concat(own, _pairs(own)), lambda g: g.isin(list(model.weights))))
    rows = windows(docs, model).withColumn("grams", grams)
    z = F.aggregate("grams", bias, lambda acc, g: F.zip_with(acc, weights(g), lambda a, v: a + v))
    rows = rows.withColumn("p", F.transform(z, lambda v: 1 / (1 + F.exp(-v))))
    reached = F.filter(
        F.arrays_zip(_strings(model.families).alias("family"), F.array(*map(F.lit, model.limits)).alias("limit"), F.col("p").alias("p")),
        lambda x: x["p"] >= x["limit"]
    )
    rows = rows.withColumn("reached", reached).where(F.size("reached") > 0)
    near = F.col("near")
    rows = rows.withColumn("near", F.array_distinct(F.concat(near, _pairs(near), _pairs(near, 3))))
    confirmed = lambda f: F.coalesce(
        F.exists(F.element_at(templates, f), lambda t: F.size(F.array_intersect(t, F.col("near"))) >= opt.confirm * F.size(t)), F.lit(False)
    )
    each = rows.select(
        "doc_id", "paragraph",
        F.explode(
            F.transform(
                "reached", lambda x: F.struct(x["family"].alias("family"), x["p"].alias("p"), confirmed(x["family"]).alias("confirmed"))
            )
        ).alias("x")
    )
    return each.select("doc_id", "paragraph", "x.family", F.col("x.p").alias("probability"), "x.confirmed")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each family of each licence paragraph, or one of `unknown`; repeated rows of a document stay repeated."""
    model = model or train()
    numbered = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    found = paragraphs(numbered.select(F.struct("doc_id", "_row").alias("doc_id"), "text"), model)
    per = found.groupBy("doc_id", "paragraph", "family").agg(
        F.max("probability").alias("probability"), F.max("confirmed").alias("confirmed")
    )
    all_ = per.groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("family", "probability", "confirmed"))).alias("all"))
    named = F.filter("all", lambda x: x["family"] != ANY)
    unknown = F.transform(
        F.filter("all", lambda x: x["family"] == ANY),
        lambda x: F.struct(F.lit("unknown").alias("family"), x["probability"].alias("probability"), F.lit(False).alias("confirmed"))
    )
    shown = all_.select("doc_id", "paragraph", F.explode(F.when(F.size(named) > 0, named).otherwise(unknown)).alias("x"))
    return shown.select("doc_id.doc_id", "paragraph", "x.family", "x.probability", "x.confirmed")


def query(spark, sf_dir: str) -> DataFrame:
    docs = frames.pick(frames.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return scan(docs).select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), "confirmed")
