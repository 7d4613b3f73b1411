"""Licence families of paragraphs by multinomial logistic regression on word n-grams.

A paragraph is a line with words, or lines in a row of which all but the last end within a
sentence, as in a wrapped notice.  Its hashed words, pairs and triples have weights for
each family and for "unknown", fitted on pieces of licence notices against paragraphs of
the corpus (a bounded sample) and sentences that speak of licences and grant none.  A
temperature calibrates the probabilities; it is fitted on notices of which the model has
seen no piece.  What the classifier names is compared with the family's notices and kept
only if enough of its word pairs or triples are theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import lean, materialize, sampled, table
from .wordhash import Words, mix, slices

# Customary notices and well-known sentences of each family.
NOTICES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "This project is available under the Apache License 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Distributed under the terms of the Apache License Version 2.0.", "This file is covered by the Apache License 2.0.", "Released under the Apache 2.0 license."),
    "mit": ("Released under the MIT License.", "SPDX-License-Identifier: MIT", "This software is licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "This project is licensed under the terms of the MIT license.", "Distributed under the MIT License.", "Available under the MIT licence, see the LICENSE file."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "Licensed under the GNU General Public License, version 3 or later.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.", "Released under the GPL version 3.", "Distributed under the GNU GPL v3 or any later version.", "Licensed under GPL-3.0."),
    "gpl-2.0": ("Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "Released under the GPL version 2.", "Distributed under the GNU GPL v2.", "Licensed under GPL-2.0."),
    "lgpl": ("Licensed under the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is distributed under the terms of the GNU Lesser General Public License version 2.1 or later.", "Released under the LGPL version 3.", "This library is covered by the GNU Lesser General Public License."),
    "bsd": ("Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Distributed under the BSD 2-Clause License.", "This software is licensed under the BSD license.", "Licensed under the 3-clause BSD license."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License 2.0.", "Distributed under the Mozilla Public License, v. 2.0.", "Released under the MPL 2.0."),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Published under the CC BY 3.0 licence.", "Available under the Creative Commons Attribution 4.0 licence.", "This article is distributed under CC BY 4.0."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Published under CC BY-NC 3.0.", "Available under the Creative Commons Attribution-NonCommercial 4.0 licence.", "This article is distributed under CC BY-NC 4.0."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Published under CC BY-SA 3.0.", "Available under the Creative Commons Attribution-ShareAlike 4.0 licence.", "This article is distributed under CC BY-SA 4.0."),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "This work has been released into the public domain.", "The author dedicates this work to the public domain under CC0 1.0."),
    "proprietary": ("All rights reserved.", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "This document is proprietary and confidential.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Unauthorized copying or distribution is strictly prohibited.", "This software is proprietary and confidential."),
}
#: Sentences that mention licences, rights or permission and aren't notices.
MENTIONS = (
    "A driving license is needed to hire a car in most countries.", "The committee discussed which license the library should use next year.", "Her poetic license with the facts annoyed the historians.",
    "The city issued a new licence to the taxi company.", "He copied the file to another medium and restricted access to it.", "The museum reserved all seats for the members of the public.",
    "Version 2.0 of the report was written in prose and without errors.", "The conditions of the contract were met and the work was redistributed among the staff.", "Copyright law is taught in the third year.",
    "Our software runs on machines of any kind and is easy to modify.", "The general public may visit the foundation on Sundays.", "Permission to land was granted late in the evening.", "They asked whether a dog license expires after one year.",
    "The Apache helicopters returned to their base.", "Students at MIT built a bridge of spaghetti.", "The Berkeley campus is open to visitors.", "Mozilla published a browser in 2004.", "The domain of the function is the set of real numbers.",
    "Creative people seldom share their work before it is done.", "The lawyer explained the rights of tenants and the duties of owners.", "No part of the bridge was closed for repair.", "This document describes how the pump is mounted.",
)
FAMILIES = (*NOTICES, "unknown")
TABLE = 1 << 16
#: Paragraphs of the corpus in the training sample, from as many documents.
SAMPLE = 1000
#: Share of a paragraph's pairs, or of a notice's, that must agree.
AGREE = 0.6
_SEPARATORS = {b for b in range(128) if not chr(b).isalnum()}
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ENDS = np.frombuffer(b".!?:;", dtype=np.uint8)


def _grams(h: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs and triples within groups, and the group of each."""
    out, where = [h], [group]
    with np.errstate(over="ignore"):
        for k in (1, 2):
            if len(h) > k:
                same = group[k:] == group[:-k]
                roll = h[:-k] * _STEP
                for t in range(1, k + 1):
                    roll = (roll + h[t : len(h) - k + t]) * _STEP
                out.append(mix(roll + np.uint64(k))[same])
                where.append(group[k:][same])
    return np.concatenate(out), np.concatenate(where)


class LicenseModel:
    def __init__(self, others: list[str], seed: int = 7, rounds: int = 40):
        self.words = Words(_SEPARATORS)
        pairs = lambda t: set(zip(a := self._list(t), a[1:], strict=False)) or set(zip(a, strict=True))
        self.pairs = {f: [pairs(n) for n in v] for f, v in NOTICES.items()}
        others = [o for o in others if self.names_no_notice(o)] + list(MENTIONS)
        # whole notices and a fifth of the other paragraphs held back, for the temperature
        held = {f: {n for i, n in enumerate(v) if i % 3 == 2} for f, v in NOTICES.items()}
        self._train([o for i, o in enumerate(others) if i % 5], {f: [n for n in v if n not in held[f]] for f, v in NOTICES.items()}, seed, rounds)
        texts = [n for v in held.values() for n in sorted(v)] + others[::5][:200]
        y = np.array([k for k, v in enumerate(held.values()) for _ in v] + [len(NOTICES)] * len(others[::5][:200]))
        z = self._margins(texts)
        loss = {}
        for t in np.geomspace(0.2, 5, 30):
            v = z / t
            loss[t] = -(v[np.arange(len(y)), y] - np.log(np.exp(v - v.max(1, keepdims=True)).sum(1)) - v.max(1)).mean()
        self.temperature = float(min(loss, key=loss.get))
        #: Shares of the unseen notices that the first model names rightly, and of unseen other paragraphs.
        right = z.argmax(1) == y
        self.held_notices, self.held_others = float(right[y < len(NOTICES)].mean()), float(right[y == len(NOTICES)].mean()) if (y == len(NOTICES)).any() else 1.0
        self._train(others, {f: list(v) for f, v in NOTICES.items()}, seed, rounds)

    def names_no_notice(self, text: str) -> bool:
        """Whether a paragraph may stand for "unknown": one that agrees with a notice may not."""
        return all(self.confirmed(text, f) < AGREE for f in NOTICES)

    def _train(self, others: list[str], known: dict[str, list[str]], seed: int, rounds: int) -> None:
        r = np.random.default_rng(seed)
        texts, y = [], []
        for k, notices in enumerate(known.values()):
            for n in notices:
                w = n.split()
                for i in range(24):
                    some = w if i < 4 else [x for x in w if r.random() > 0.12] or w
                    if i >= 12 and others:  # inside other words
                        o = others[r.integers(len(others))].split()[: int(r.integers(0, 5))]
                        some = some + o if r.random() < 0.5 else o + some
                    texts.append(" ".join(some))
                    y.append(k)
        vocabulary = sorted({w for v in known.values() for n in v for w in n.split()})
        for o in others:
            w = o.split()
            if r.random() < 0.3:  # words of notices alone don't make one
                w.insert(int(r.integers(0, len(w) + 1)), vocabulary[r.integers(len(vocabulary))])
            texts.append(" ".join(w))
            y.append(len(NOTICES))
        for _ in range(400):
            texts.append(" ".join(r.choice(vocabulary, int(r.integers(2, 9)))))
            y.append(len(NOTICES))
        y = np.array(y)
        gram, doc = self._grams_of(texts)
        scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(texts)), 1))
        want = np.eye(len(FAMILIES))[y]
        cost = 1 / np.bincount(y, minlength=len(FAMILIES))[y]
        cost *= len(texts) / cost.sum()
        # each entry (gram, text) once, with how often; by text for the margins, by gram for the steps
        both, times = np.unique(doc * TABLE + gram, return_counts=True)
        doc, gram, times = both // TABLE, both % TABLE, times.astype(np.float32)[:, None]
        used, gram = np.unique(gram, return_inverse=True)
        some, heads = np.unique(doc, return_index=True)
        turned = np.argsort(gram, kind="stable")
        by_gram, turned_times = np.searchsorted(gram[turned], np.arange(len(used))), times[turned]
        doc_turned = doc[turned]
        self.weight = np.zeros((len(used), len(FAMILIES)), dtype=np.float32)
        past = np.zeros(self.weight.shape, dtype=np.float32)
        for _ in range(rounds):  # full-batch steps with per-weight rates
            z = np.zeros((len(texts), len(FAMILIES)), dtype=np.float32)
            z[some] = np.add.reduceat(self.weight[gram] * times, heads, axis=0)
            z *= scale[:, None]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = ((p - want) * (cost * scale)[:, None]).astype(np.float32)
            step = np.add.reduceat(g[doc_turned] * turned_times, by_gram, axis=0)
            past += step**2
            self.weight -= 0.3 * step / np.sqrt(past + 1e-8)
        whole = np.zeros((TABLE, len(FAMILIES)), dtype=np.float32)
        whole[used] = self.weight
        self.weight = whole

    def _margins(self, texts: list[str]) -> np.ndarray:
        gram, doc = self._grams_of(texts)
        return self._sum(gram, doc, len(texts)) / np.sqrt(np.maximum(np.bincount(doc, minlength=len(texts)), 1))[:, None]

    def _list(self, text: str) -> list[int]:
        return self.words.of(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8))[2].tolist()

    def _grams_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(self._list(t), dtype=np.uint64) for t in texts]
        gram, doc = _grams(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        return (gram & np.uint64(TABLE - 1)).astype(np.int64), doc

    def _sum(self, gram: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(FAMILIES)))
        for k in range(len(FAMILIES)):
            out[:, k] = np.bincount(doc, self.weight[gram, k], n)
        return out

    def confirmed(self, text: str, family: str) -> float:
        """Largest share of word pairs in common with a notice, of the smaller side with three pairs or more.

        Only a notice that is shorter itself is confirmed by fewer pairs, and by all of its own:
        a short paragraph is no proof, as two words of a notice ("this work") are said anywhere.
        """
        a = self._list(text)
        mine = set(zip(a, a[1:], strict=False)) or set(zip(a, strict=True))
        best = 0.0
        for theirs in self.pairs[family]:
            both = len(mine & theirs)
            if both >= min(3, len(theirs)):
                best = max(best, both / min(len(mine), len(theirs)))
        return best

    def scan(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, str, float, float]]]:
        """Paragraphs per text, and (row, line, family, probability, agreement) of the confirmed ones."""
        n = len(off) - 1
        if n > 1:
            data = np.insert(data, off[1:-1], np.uint8(10))
            off = off + np.arange(n + 1)
            off[-1] -= 1
        starts, ends, h = self.words.of(data)
        if not len(h):
            return np.zeros(n, dtype=np.int64), []
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts)
        new = np.append(True, line[1:] != line[:-1])
        head = np.flatnonzero(new)
        # a line goes on in the next one if it ends within a sentence and no blank line or text end lies between
        tail = np.append(head[1:], len(h)) - 1
        row = np.searchsorted(off, starts[head], side="right") - 1
        count = np.bincount(row, minlength=n)
        stop = breaks[np.minimum(line[head], len(breaks) - 1)] if len(breaks) else np.full(len(head), len(data))
        ended = np.append(0, np.cumsum(np.isin(data, _ENDS)))
        edge = np.minimum(np.maximum(stop, ends[tail]), len(data))
        sign = ended[edge] > ended[ends[tail]]  # a full stop or the like after the line's last word
        goes_on = ~sign[:-1] & (line[head][1:] == line[head][:-1] + 1) & (row[1:] == row[:-1])
        found = self._named(data, starts, ends, h, np.cumsum(new) - 1, head, tail)
        if goes_on.any():
            block = np.cumsum(np.append(True, ~goes_on)) - 1
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            last = np.append(first[1:], len(block)) - 1
            many = last > first
            whole = self._named(data, starts, ends, h, block[np.cumsum(new) - 1], head[first], tail[last], many)
            for i, got in whole.items():  # a wrapped notice is one, though its lines may pass alone
                lone = [k for k in range(first[i], last[i] + 1) if k in found and found[k][0] == got[0]]
                if not lone:
                    if not any(k in found for k in range(first[i], last[i] + 1)):
                        found[int(first[i])] = got
                elif len(lone) > 1:
                    for k in lone:
                        del found[k]
                    found[lone[0]] = got
        out = []
        for i in sorted(found):
            begins = int(np.searchsorted(breaks, off[row[i]]))
            out.append((int(row[i]), int(line[head[i]] - begins), *found[i]))
        return count, out

    def _named(self, data, starts, ends, h, part, head, tail, some=None) -> dict[int, tuple[str, float, float]]:
        """Family, probability and agreement of the confirmed ones of word runs ``part``, which begin and end at words ``head``, ``tail``."""
        gram, where = _grams(h, part)
        order = np.argsort(where, kind="stable")
        gram, where = (gram[order] & np.uint64(TABLE - 1)).astype(np.int64), where[order]
        cut = np.searchsorted(where, np.arange(len(head)))
        size = np.diff(np.append(cut, len(where)))
        # the gap to "unknown" decides what is looked at
        z = np.stack([np.add.reduceat(self.weight[gram, k], cut) for k in range(len(FAMILIES))], axis=1) / np.sqrt(size)[:, None] / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        top = p.argmax(1)
        look = (top < len(NOTICES)) & (p[:, -1] < 0.5)
        found = {}
        for i in np.flatnonzero(look if some is None else look & some):
            family = FAMILIES[top[i]]
            agree = self.confirmed(data[starts[head[i]] : ends[tail[i]]].tobytes().decode("utf-8", "replace"), family)
            if agree >= AGREE:
                found[int(i)] = (family, float(p[i, top[i]]), agree)
        return found


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Takes SAMPLE paragraphs out of SAMPLE documents, by smallest hash, as "unknown".

    Those that agree with a notice are left out; others that mention licences stay.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    lines = sampled(texts, "id", "text", SAMPLE).select(F.explode(F.split("text", "\n")).alias("p")).where(F.length(F.trim("p")) > 0)
    got = sampled(materialize(lines.distinct(), "lines").withColumn("id", F.col("p")), "id", "p", SAMPLE).select("h", "p").collect()
    return LicenseModel([r["p"] for r in sorted(got)])


def _scan(model: LicenseModel):
    schema = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("found", pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("p", pa.float64()), ("agreement", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                count, found = model.scan(data, off)
                rows: list[list[dict]] = [[] for _ in range(j - i)]
                for r, line, family, p, agree in found:
                    rows[r].append({"line": line, "family": family, "p": p, "agreement": agree})
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), pa.array(rows, schema.field("found").type)], schema=schema)

    return run


def scan_licenses(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, found) of every row; ``found`` has line, family, p, agreement of each notice.

    Null and empty texts have no paragraphs.  Rows with equal or null ids stay separate; other
    columns are ignored; an empty table gives no rows.
    """
    kind = "doc_id long, n_paragraphs long, found array<struct<line:int,family:string,p:double,agreement:double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_scan(model)), kind)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan_licenses(docs, fit(docs))
    return out.select("doc_id", "n_paragraphs", F.array_sort(F.array_distinct("found.family")).alias("families"), F.size("found").cast("long").alias("n_notices"), F.array_max("found.p").alias("p"))


#: A fitted model; tested by held-out accuracy and planted notices.
QUERIES, ORACLES = {"op7_license_scan": op7_license_scan}, {}
