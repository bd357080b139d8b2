"""Licence paragraphs by a trained classifier, with an unknown class and comparison with templates.

The paragraphs of a text are its runs of lines between blank lines, without comment marks.  A logistic
regression over sparse word unigrams and bigrams tells licence families from each other and from other text,
the unknown class.  It learns from the templates below, also in parts and in other surroundings, and from a
bounded sample of the corpus's own lines as unknown: plain ones, and hard ones that speak of licences but hold
no template.  Half of each kind is held out.  On these the probabilities are calibrated by a temperature, and
the threshold is set.  A notice is a window of a paragraph, a little longer than
a template at most, that holds enough of the template and its version numbers; it counts when it is predicted
to be of the template's family, and of windows that overlap the one with the largest share of its template.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import in_slices

#: Short notices of public licences, by family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
#: Names that short notices give, by family, and such notices.
NAMES = {"Apache-2.0": ["Apache-2.0", "Apache 2.0"], "BSD-3-Clause": ["BSD", "BSD-3-Clause", "3-Clause BSD"], "GPL-2.0": ["GPLv2", "GPL-2.0"], "GPL-3.0": ["GPLv3", "GPL-3.0"], "LGPL-3.0": ["LGPLv3", "LGPL-3.0"], "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0", "MPL 2.0"]}
NOTICES = ["Distributed under the terms of the {} license", "Released under the {} license", "This project is {} licensed", "Licensed under the {} license", "Released under {} license", "Licensed under {} license"]
#: Names of public licences without a template.
OTHERS = ["AGPLv3", "EPL-2.0", "CDDL", "Artistic", "Zlib", "ISC", "WTFPL", "Boost", "Unlicense", "EUPL"]
#: What before a notice denies it: learnt from, and held out.
DENIED, DENIED_HELD = [["not"], ["is", "not"], ["never"], ["no", "longer"]], [["was", "not"], ["was", "never"]]
#: Lines of the corpus that stand for the unknown class at most, about, of each kind; half are held out.
UNKNOWN = 4000
#: Words that make a line a hard one.
HARD = "licen[cs]|copyright|permission"
#: Share of held-out unknown paragraphs that may pass, and of a template's bigrams that must be there.
PASS, HELD = 0.001, 0.8


def words_of(text: str) -> list[str]:
    """Words in lower case without marks; both spellings of licence are one."""
    return [w for w in (x.strip(".,;:()\"'").replace("licence", "license") for x in text.lower().split()) if w]


def templates() -> dict[str, list[str]]:
    """All templates by family: the fixed ones, and short notices of the names."""
    return {f: [*known, *(n.format(x) for x in NAMES.get(f, []) for n in NOTICES if n.format(x) + "." not in known)] for f, known in TEMPLATES.items()}


def grams_of(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:]))}


#: What begins and ends the lines of comments.
_MARKS = re.compile(r"""^\s*(?:<!--+|/\*+|\*+/?|//+|\#+|;+|--+|%+|>+|\|+|\.\.\s|dnl\b|rem\b|\"{3}|'{3}|\(\*)?|\s*(?:\*+/?|--+>|\*\)|\#+|\|+)?\s*$""", re.IGNORECASE)


def paragraphs(text: str) -> list[str]:
    """Runs of lines between blank lines, in order, without comment marks."""
    out, last = [], []
    for line in text.split("\n"):
        line = _MARKS.sub("", line)
        if line.strip():
            last.append(line)
        elif last:
            out.append("\n".join(last))
            last = []
    return [*out, "\n".join(last)] if last else out


def numbers_of(words: list[str] | set[str]) -> set[str]:
    """Words with digits, whole versions as their first number."""
    return {re.sub(r"(\.0)+$", "", w) for w in words if any(c.isdigit() for c in w)}


class Template:
    def __init__(self, family: str, text: str):
        self.family, words = family, words_of(text)
        self.grams, self.words, self.numbers = frozenset(grams_of(words)), frozenset(words), numbers_of(words)
        self.least, self.longest = HELD * len(self.grams), len(words) + max(2, len(words) // 4)

    def windows(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Windows (from, to, share) of words that hold enough, without overlaps, the largest shares first."""
        held, counts, left = Counter(), np.zeros(len(words), np.int64), 0
        pair = [f"{a} {b}" for a, b in zip(words, words[1:])]
        for right, word in enumerate(words):
            held.update(g for g in (word, pair[right - 1] if right > left else "") if g in self.grams)
            if right - left == self.longest:
                for g in (words[left], pair[left]):
                    if g in self.grams:
                        held[g] -= 1
                        if not held[g]:
                            del held[g]
                left += 1
            counts[right] = len(held)
        out, free = [], np.ones(len(words), bool)
        ends = np.flatnonzero(counts >= self.least)
        for last in ends[np.argsort(-counts[ends], kind="stable")].tolist():  # of equal ones the first end
            if not free[last]:
                continue
            first, most = max(0, last - self.longest + 1), int(counts[last])
            while len(grams_of(words[first + 1 : last + 1]) & self.grams) == most:
                first += 1
            out.append((first, last + 1, most / len(self.grams)))
            free[first : last + len(self.words)] = False
        return out


@dataclass
class Model:
    families: list[str]
    grams: dict[str, int]
    weight: np.ndarray  # grams and a constant, by family and last the unknown class
    threshold: float
    temperature: float = 1.0
    templates: list[Template] = field(default_factory=list)
    anchors: dict[str, list[int]] = field(default_factory=dict)  # templates by words of which each notice of theirs has one

    def __post_init__(self):
        self.words = {w for g in self.grams for w in g.split()}

    def scores(self, paragraphs: list[list[str]]) -> np.ndarray:
        return softmax(Rows([grams_of(words) for words in paragraphs], self.grams).times(self.weight) / self.temperature)

    def notices(self, paragraph: str) -> list[tuple[str, float]]:
        """The families of a paragraph's notices and their probabilities, each once, in order."""
        words = words_of(paragraph)
        own = self.words.intersection(words)
        near = sorted({i for w in own for i in self.anchors.get(w, ())})
        likely = [t for t in map(self.templates.__getitem__, near) if len(t.grams) - t.least >= len(t.words) - len(t.words & own)]
        if not likely:
            return []
        grams, found = grams_of(words), []
        for t in likely:
            if len(t.grams & grams) < t.least:
                continue
            for a, b, share in t.windows(words):
                x, y = a, b
                for _ in range(2):  # words beside it that may tell families apart
                    x -= x > 0 and words[x - 1] in self.words
                    y += y < len(words) and words[y] in self.words
                if t.numbers <= numbers_of(words[x:y]):
                    found.append((share, a, b, t.family, words[x:y]))
        found.sort(key=lambda x: (-x[0], x[1] - x[2], x[1]))
        kept: list[tuple[int, int, str, float]] = []
        taken: dict[int, set[str]] = {}  # families by word
        for i in range(0, len(found), 1000):
            some = found[i : i + 1000]
            for (_, a, b, family, _), p in zip(some, self.scores([window for *_, window in some])):
                if p.argmax() == self.families.index(family) and p.max() >= self.threshold and all(taken.get(k, {family}) == {family} for k in range(a, b)):
                    kept.append((a, b, family, float(p.max())))
                    for k in range(a, b):
                        taken.setdefault(k, set()).add(family)
        best: dict[str, float] = {}
        for _, _, family, p in sorted(kept):
            best[family] = max(p, best.get(family, 0.0))
        return list(best.items())

    def find(self, text: str) -> tuple[str, float] | None:
        """The first family of a paragraph and its probability, or none."""
        return next(iter(self.notices(text)), None)


def _anchors(several: list[Template], counts: Counter) -> dict[str, list[int]]:
    """Templates by their words that are rarest in other text, one more than a notice may lack."""
    out: dict[str, list[int]] = {}
    for i, t in enumerate(several):
        for w in sorted(t.words, key=lambda w: (counts[w], w))[: int(len(t.grams) - t.least) + 1]:
            out.setdefault(w, []).append(i)
    return out


def _variants(words: list[str]) -> list[list[str]]:
    """A template, parts of it, and other surroundings."""
    return [c for c in (words, words[1:], words[:-1], ["see", "here", *words], [*words, "all", "rights", "reserved"]) if len(c) > 1]


def _held_variants(words: list[str]) -> list[list[str]]:
    """Forms of a template that are not learnt from: a word left out in the middle, and other surroundings."""
    k = len(words) // 2
    return [words[:k] + words[k + 1 :], ["note", "that", *words, "for", "details"]]


def _made(held: bool) -> list[list[str]]:
    """Hard negatives: notices denied, and notices of other licences; one half is held out."""
    notices = [words_of(t) for several in templates().values() for t in several if len(t.split()) < 25]
    other = [words_of(n.format(x)) for n in NOTICES for x in OTHERS[held::2]]
    return [[*d, *w] for w in notices for d in (DENIED_HELD if held else DENIED)] + other


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Rows:
    """A sparse matrix of n-grams by text, with a column of ones; the entries of a text have length one with all its n-grams."""

    def __init__(self, texts: list[set[str]], grams: dict[str, int]):
        own = [sorted(grams[g] for g in t if g in grams) for t in texts]
        self.n = len(texts)
        self.row = np.repeat(np.arange(self.n), [len(o) for o in own])
        self.column = np.array([k for o in own for k in o], np.int64)
        self.value = np.repeat([1 / np.sqrt(max(1, len(t))) for t in texts], [len(o) for o in own])
        self.order = np.argsort(self.column, kind="stable")

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.tile(w[-1], (self.n, 1))
        if len(self.row):
            starts = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]]))
            out[self.row[starts]] += np.add.reduceat(self.value[:, None] * w[self.column], starts)
        return out

    def turned_times(self, d: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((columns, d.shape[1]))
        if len(self.row):
            column = self.column[self.order]
            starts = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            out[column[starts]] = np.add.reduceat(self.value[self.order][:, None] * d[self.row[self.order]], starts)
        out[-1] = d.sum(0)
        return out


def fit(unknown: list[str], hard: list[str] | None = None) -> Model:
    """Multinomial logistic regression by gradient steps on templates, their parts, and unknown lines of the corpus.

    ``hard`` lines that hold a template are left out.  Every second line of each kind, as they come, is held out.
    """
    known = templates()
    families = sorted(known)
    several = [Template(f, t) for f in families for t in known[f]]
    speaking = [words_of(t) for t in hard or []]
    speaking = [w for w in speaking if not any(len(t.grams & grams_of(w)) >= t.least for t in several)]
    other = [words_of(t) for t in unknown]
    rows, labels, held, held_labels = [], [], [], []
    for i, family in enumerate(families):
        for text in known[family]:
            for out, at, forms in ((rows, labels, _variants), (held, held_labels, _held_variants)):
                new = forms(words_of(text))
                out += new
                at += [i] * len(new)
    made = _made(False)
    denials = {g for r in made[: -len(NOTICES) * len(OTHERS[::2])] for g in grams_of(r)}
    grams = {g: k for k, g in enumerate(sorted({g for r in rows for g in grams_of(r)} | denials))}
    # other text around the licences' common words, so that these alone do not tell
    negatives = made + other[::2] + speaking[::2] + [[w] for w in sorted({w for r in rows for w in r})]
    last = len(families)
    y = np.array(labels + [last] * len(negatives))
    x = Rows([grams_of(r) for r in rows + negatives], grams)
    share = np.where(y < last, 0.5 / max(1, len(rows)), 0.25 / max(1, len(negatives) - len(made)))
    share[len(rows) : len(rows) + len(made)] = 0.25 / len(made)
    share = share[:, None]
    target, w, speed = np.eye(last + 1)[y], np.zeros((len(grams) + 1, last + 1)), 0
    for _ in range(400):
        speed = 0.9 * speed - 5.0 * (x.turned_times((softmax(x.times(w)) - target) * share, len(w)) + 1e-6 * w)
        w = w + speed
    rest = other[1::2] + speaking[1::2] + _made(True)
    z = Rows([grams_of(r) for r in held + rest], grams).times(w)
    y = np.array(held_labels + [last] * len(rest))
    weight = np.where(y < last, 0.5 / len(held), 0.5 / max(1, len(rest)))
    loss = lambda t: -(weight * np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12)).sum()
    temperature = min((0.25 * 1.1**k for k in range(40)), key=loss)
    model = Model(families, grams, w, 0.0, float(temperature), several, _anchors(several, Counter(x for words in other for x in set(words))))
    best = softmax(z[len(held) :] / temperature)[:, :-1].max(1) if rest else np.zeros(0)
    model.threshold = float(np.clip(np.quantile(best, 1 - PASS) if len(best) else 0.5, 0.5, 0.9))
    return model


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Fit to a corpus: about ``UNKNOWN`` of its lines of each kind, plain and hard, in the order of their hashes.

    Null and empty texts have no lines; a line that repeats counts once.  An empty corpus gives a model of the templates alone.
    """
    lines = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).where("length(line) > 0").withColumn("hard", F.expr(f"lower(line) rlike '{HARD}'"))
    sizes = {r.hard: r["count"] for r in lines.groupBy("hard").count().collect()}
    share = F.when(F.col("hard"), min(1.0, UNKNOWN / max(1, sizes.get(True, 0)))).otherwise(min(1.0, UNKNOWN / max(1, sizes.get(False, 0))))
    place = F.shiftrightunsigned(F.xxhash64("line"), 1)
    some = lines.where(place.cast("double") < share * float(1 << 63)).distinct()
    chosen = [r for hard in (False, True) for r in some.where(F.col("hard") == hard).orderBy(place, "line").limit(UNKNOWN).collect()]
    mixed = sorted(chosen, key=lambda r: zlib.crc32(r.line.encode()))
    return fit([r.line for r in mixed if not r.hard], [r.line for r in mixed if r.hard])


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``licences``: (paragraph, family, probability) of each licence paragraph, in order.

    ``paragraph`` counts from 0; a paragraph with notices of several families has an entry for each.  Null and
    empty texts have none; whole texts are searched, however long.  Repeated rows get equal results.  A column of
    that name is replaced, others pass; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in (text, "licences")]
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the templates

    def run(batches):
        model = shared.value
        for batch in batches:
            for a, b, texts in in_slices(batch.column(len(kept))):
                out = []
                for t in texts:
                    out.append([{"paragraph": i, "family": f, "probability": p} for i, paragraph in enumerate(paragraphs(t or "")) for f, p in model.notices(paragraph)])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], pa.array(out, kind)], names=[*kept, "licences"])

    schema = T.StructType([*(docs.schema[c] for c in kept)]).add("licences", T.DataType.fromDDL("array<struct<paragraph:int,family:string,probability:double>>"))
    return docs.select(*kept, text).mapInArrow(run, schema)
