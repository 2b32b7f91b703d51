"""Licence scans: sparse TF-IDF cosine to templates, and inheritance along directories (operator 1)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worthline.llm.common import map_batches, texts
from worthline.operators.lookup import lookup_join
from worthline.session import written

#: Least cosine of a statement to a template.
LEAST = 0.6

# Notices by which each licence is stated.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. The software is provided as is, without warranty of any kind.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
    ],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "BSD-3-Clause": [
        "Released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions must retain the above copyright notice; neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products.",
    ],
    "BSD-2-Clause": ["Released under the 2-Clause BSD License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: A statement holds one of these words; other lines are not compared.
MARKER = re.compile(r"licen[sc]|permission|redistribut|public domain|copyright", re.I)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("licence", "license"))


class Matcher:
    """Weighted templates; words that no template has count with the weight of an unseen word."""

    def __init__(self, templates: dict[str, list[str]], idf: dict[str, float], unseen: float):
        self.idf, self.unseen = idf, unseen
        self.names, self.index = [], {}
        for licence, items in sorted(templates.items()):
            for item in items:
                vector, norm = self.weights(Counter(words(item)))
                self.names.append(licence)
                for word, weight in vector.items():
                    self.index.setdefault(word, []).append((len(self.names) - 1, weight / norm))

    def weights(self, counts: Counter) -> tuple[dict[str, float], float]:
        vector = {w: n * self.idf.get(w, self.unseen) for w, n in counts.items()}
        return vector, max(sum(v * v for v in vector.values()) ** 0.5, 1e-12)

    def best(self, text: str) -> tuple[float, str | None]:
        """The highest cosine of a text to a template, over an inverted index of the templates."""
        vector, norm = self.weights(Counter(words(text)))
        sums = np.zeros(len(self.names))
        for word, weight in vector.items():
            for template, other in self.index.get(word, ()):
                sums[template] += weight * other
        place = int(np.argmax(sums)) if len(sums) else 0
        return (float(sums[place]) / norm, self.names[place]) if len(sums) and sums[place] > 0 else (0.0, None)

    def scan(self, text: str) -> tuple[float, str | None]:
        """The best match among the lines with a marker, their paragraphs and the whole text.

        Equal cosines go to the first statement, then to the licence first in order of name.
        """
        best, last_line, last_paragraph = (0.0, None), -1, -1
        for m in MARKER.finditer(text):
            start = text.rfind("\n", 0, m.start()) + 1
            if start == last_line:
                continue
            last_line = start
            end = text.find("\n", m.start())
            end = len(text) if end < 0 else end
            best = max(best, self.best(text[start:end]), key=lambda x: x[0])
            above = text.rfind("\n\n", 0, m.start()) + 1
            if above != last_paragraph:
                last_paragraph = above
                below = text.find("\n\n", m.start())
                best = max(best, self.best(text[above : below if below >= 0 else len(text)]), key=lambda x: x[0])
        return best


def template_frequencies(df: DataFrame, text: str, vocabulary: frozenset[str]) -> tuple[dict[str, int], int]:
    """In how many texts each template word stands, over all texts; only the vocabulary reaches the driver."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            counts: Counter = Counter()
            items = texts(batch)
            for item in items:
                counts.update(vocabulary.intersection(words(item)))
            counts[""] = len(items)
            return {"word": list(counts), "n": list(counts.values())}

        return run

    counted = map_batches(df.select(F.col(text).cast("string").alias("text")), "word string, n long", make)
    totals = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return totals, totals.pop("", 0)


def scan_licences(
    files: DataFrame,
    path: str = "path",
    text: str = "text",
    key: str = "doc_id",
    licence_file: Column | None = None,
    templates: dict[str, list[str]] = TEMPLATES,
    least: float = LEAST,
) -> DataFrame:
    """Return key, path, licence, score, origin (own, inherited, none) and from_dir: one row per file.

    A file has its own licence if a statement in it (a line, a paragraph) has a TF-IDF cosine of at
    least ``least`` to a template; document frequencies of the template words are counted over all
    files. Licence files speak for their directory: those that ``licence_file`` names, by default
    files called LICENSE, COPYING, NOTICE and the like. If several disagree, the most frequent
    licence holds, then the one with the higher score, then the first by name. A file without its
    own licence takes that of the nearest directory above it that has one, itself included.

    Null and empty texts have no licence of their own; files with a null path inherit nothing;
    repeated paths are files like others. ``files`` may hold other columns; they are not read.
    """
    source = files.select(F.col(key).alias("doc_id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"), *([licence_file.alias("speaks")] if licence_file is not None else []))
    vocabulary = frozenset(w for items in templates.values() for item in items for w in words(item))
    seen, n = template_frequencies(source, "text", vocabulary)
    idf = {w: float(np.log((1 + n) / (1 + seen.get(w, 0))) + 0.1) for w in vocabulary}
    unseen = float(np.log(1 + n) + 0.1)

    def make():
        matcher = Matcher(templates, idf, unseen)

        def run(batch: pa.RecordBatch) -> dict:
            found = [matcher.scan(t) for t in texts(batch)]
            own = {name: batch[name] for name in batch.schema.names if name != "text"}
            return own | {
                "score": [round(s, 9) if s >= least else None for s, _ in found],
                "licence": [name if s >= least else None for s, name in found],
            }

        return run

    if licence_file is None:
        name = F.element_at(F.split("path", "/"), -1)
        source = source.withColumn("speaks", name.rlike(r"(?i)^(licen[sc]e|copying|copyright|unlicense|notice)"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scanned = map_batches(source, f"doc_id {kind}, path string, speaks boolean, score double, licence string", make)
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    scanned = written(scanned.withColumn("folder", folder), "licences")

    votes = scanned.filter(F.col("speaks") & F.col("licence").isNotNull() & F.col("folder").isNotNull())
    votes = votes.groupBy("folder", "licence").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    rank = Window.partitionBy("folder").orderBy(F.col("n").desc(), F.col("score").desc(), "licence")
    licensed = votes.withColumn("_r", F.row_number().over(rank)).filter("_r = 1")
    licensed = licensed.select(F.col("folder").alias("above"), F.col("licence").alias("shared"), F.col("score").alias("shared_score"))

    # nearest licensed folder of every distinct folder: a join of all its ancestors with the licensed ones
    folders = scanned.filter(F.col("folder").isNotNull()).select("folder").distinct()
    parts = F.split("folder", "/")
    ancestors = F.array_distinct(
        F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), F.array(F.lit("")))
    )
    steps = folders.select("folder", F.explode(ancestors).alias("above"))
    nearest = steps.join(licensed, "above").groupBy("folder").agg(
        F.max_by(F.struct("above", "shared", "shared_score"), F.length("above")).alias("_n")
    )
    nearest = nearest.select("folder", "_n.*")
    joined = lookup_join(scanned, nearest, ["folder"])
    own = F.col("licence").isNotNull()
    origin = F.when(own, "own").when(F.col("shared").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        F.col("doc_id").alias(key),
        "path",
        F.coalesce("licence", "shared").alias("licence"),
        F.when(own, F.col("score")).otherwise(F.col("shared_score")).alias("score"),
        origin.alias("origin"),
        F.when(~own, F.col("above")).alias("from_dir"),
    )
