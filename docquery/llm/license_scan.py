"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then nearest-ancestor inheritance.

Terms are runs of letters, digits and dots between them, lower-cased. Document frequencies of the templates' terms are
counted over all rows; a term outside the templates counts as one seen once. Each text is cut into sentences (at line
ends, and at a full stop before white space); wherever a sentence holds an anchor (a term found in the templates'
first words: licensed, license, copyright, ...), windows of 1 to SPAN sentences from there on are compared with every
template, and the best cosine of THRESHOLD or more names the licence. Whole texts are read, not their first lines.

The whole text is compared with the licences' full texts (``licences``, any number of lines): a cosine of FULL or more
makes it a licence file. So does a best window that holds FILE_SHARE of its terms, and a match of THRESHOLD or more in a
file named as licence files are (LICENSE, COPYING, ...); any other match is a header. A directory has
the licence of its licence file (of the best score, then the least name); files without header or licence of their
own inherit that of the nearest ancestor directory which has one. Ancestors are resolved for each distinct directory,
by an equi-join on the path; no pairs of files are made.

Defined results: null and empty texts have no licence of their own; a null path has no ancestors; repeated rows give a row
each; ties go to the least licence id; an empty table gives no rows. Columns other than doc_id, path and text aren't read.
"""

from __future__ import annotations

import re
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, table

THRESHOLD, FILE_SHARE, SPAN, FULL = 0.6, 0.8, 6, 0.9
#: Short notices as the licences' own texts recommend them.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Licensed under the Apache License, Version 2.0."),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "Licensed under the MIT License.", "Released under the MIT License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License."),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "This work is licensed under the GNU General Public License, version 2."),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "This work is licensed under the GNU General Public License, version 3."),
    "LGPL-3.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License", "Licensed under the GNU Lesser General Public License, version 3."),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal public domain dedication.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Proprietary and confidential. All rights reserved."),
}
ANCHORS = ("licensed", "license", "licence", "licensed.", "permission", "redistribution", "redistribute", "released", "copyright", "spdx", "proprietary", "rights", "reserved", "unencumbered")
_TERM = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=\.)\s+|[\r\n]+")
_ANCHOR = re.compile("|".join(sorted({a.rstrip(".") for a in ANCHORS})), re.I)


def terms(s: str) -> list[str]:
    return _TERM.findall(s.lower())


VOCABULARY = sorted({t for texts in TEMPLATES.values() for x in texts for t in terms(x)})
_PLACE = {t: k for k, t in enumerate(VOCABULARY)}
_NAME = re.compile(r"(?i)(?:.*/)?(?:(?:un)?licen[cs]e|copying)(?:[-_.](?!.*\b(?:py|js|ts|java|c|h|cc|cpp|hpp|go|rs|rb|sh|php|cs|kt|json|xml|ya?ml|css)$)[^/]*)?")


def _full_texts() -> dict[str, str]:
    """The full texts at hand; those of four licences are made from their nearest relative, from which they differ in few terms."""
    out = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files(__package__).joinpath("licences").iterdir() if f.name.endswith(".txt")}
    out["AGPL-3.0"] = re.sub(r"(?i)\bGNU\s+General\b", "GNU Affero General", out["GPL-3.0"])
    out["CC-BY-4.0"] = re.sub(r"(?i)-?sharealike", "", out["CC-BY-SA-4.0"])
    out["CC-BY-NC-4.0"] = re.sub(r"(?i)sharealike", "NonCommercial", out["CC-BY-SA-4.0"])
    out["BSD-2-Clause"] = re.sub(r"(?s)\n3\. .*?\n\n", "\n\n", out["BSD-3-Clause"])
    return dict(sorted(out.items()))


FULL_TEXTS = _full_texts()
#: Terms whose documents are counted: the notices' (VOCABULARY), then those that only the full texts have.
COUNTED = VOCABULARY + sorted({t for x in FULL_TEXTS.values() for t in terms(x)} - set(VOCABULARY))
_COUNTED_PLACE = {t: k for k, t in enumerate(COUNTED)}


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and in how many of them each counted term is."""

    def run(batches):
        n, df, wanted = 0, np.zeros(len(COUNTED), np.int64), set(COUNTED)
        for b in batches:
            for t in b["text"]:
                n += 1
                for w in wanted & set(terms(t.as_py() or "")):
                    df[_COUNTED_PLACE[w]] += 1
        yield pa.RecordBatch.from_pydict({"term": pa.array([-1, *range(len(df))], pa.int64()), "n": pa.array([n, *df], pa.int64())})

    got = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas().set_index("term")["n"]  # a row for each term
    return int(got.get(-1, 0)), np.array([got.get(k, 0) for k in range(len(COUNTED))], np.int64)


class Model:
    def __init__(self, rows: int, df: np.ndarray):
        self.full_idf = np.log((1 + rows) / (1 + df)) + 1
        self.idf = self.full_idf[: len(VOCABULARY)]
        self.unknown = float(np.log((1 + rows) / 2) + 1) if rows else 1.0
        self.names = [name for name, texts in sorted(TEMPLATES.items()) for _ in texts]
        self.matrix = np.stack([self.vector(terms(x))[0] for _, texts in sorted(TEMPLATES.items()) for x in texts])
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.full_names = list(FULL_TEXTS)
        self.full = np.stack([self.vector(terms(x), _COUNTED_PLACE, self.full_idf)[0] for x in FULL_TEXTS.values()])
        self.full /= np.linalg.norm(self.full, axis=1, keepdims=True)

    def vector(self, words: list[str], place: dict[str, int] | None = None, idf: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """TF-IDF over the vocabulary (the notices' if none is given), and the square of the norm of the rest."""
        place, idf = (_PLACE, self.idf) if place is None else (place, idf)
        v, others = np.zeros(len(idf)), {}
        for w in words:
            k = place.get(w)
            if k is None:
                others[w] = others.get(w, 0) + 1
            else:
                v[k] += 1
        return v * idf, sum((c * self.unknown) ** 2 for c in others.values())

    def whole(self, words: list[str]) -> tuple[str, float]:
        """The licence whose full text is nearest to all the words, and the cosine."""
        v, rest = self.vector(words, _COUNTED_PLACE, self.full_idf)
        scores = np.round(self.full @ v / np.sqrt((v * v).sum() + rest), 6)
        at = int(scores.argmax())
        return self.full_names[at], float(scores[at])

    def best(self, text: str, path: str = "") -> tuple[str | None, float, bool]:
        """Licence, cosine and whether the text is a licence file."""
        if not _ANCHOR.search(text):
            return None, 0.0, False
        parts = [terms(p) for p in _SENTENCE.split(text)]
        parts = [p for p in parts if p]
        total = sum(map(len, parts))
        name, score = self.whole([w for p in parts for w in p])
        named = _NAME.fullmatch(path) is not None
        if score >= FULL or named and score >= THRESHOLD:
            return name, score, True
        found: tuple[float, str | None, int] = (0.0, None, 0)
        for i, p in enumerate(parts):
            if not any(_ANCHOR.search(w) for w in p):
                continue
            for j in range(max(0, i - 1), i + 1):
                for k in range(i + 1, min(len(parts), i + SPAN) + 1):
                    words = [w for q in parts[j:k] for w in q]
                    v, rest = self.vector(words)
                    norm = np.sqrt((v * v).sum() + rest)
                    scores = np.round(self.matrix @ v / norm, 6)
                    at = int(scores.argmax())
                    if scores[at] > found[0]:
                        found = (float(scores[at]), self.names[at], len(words))
                    if len(words) > 400:
                        break
        if found[0] < THRESHOLD:
            return None, found[0], False
        return found[1], found[0], named or found[2] >= FILE_SHARE * total


def own_licences(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, score and is_file of each row of (doc_id, path, text)."""
    model = Model(*document_frequencies(docs))

    def run(batches):
        for b in batches:
            got = [model.best(t.as_py() or "", p.as_py() or "") for t, p in zip(b["text"], b["path"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["path"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "path", "license", "score", "is_file"])

    return docs.select("doc_id", "path", "text").mapInArrow(run, "doc_id bigint, path string, license string, score double, is_file boolean")


def inherit(own: DataFrame) -> DataFrame:
    """doc_id, license, score, found ('file', 'header', 'inherited' or 'none') and from_dir of each row of own_licences()."""
    own = own.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), ""))
    files = own.where("is_file AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("x")).select(F.col("dir").alias("from_dir"), F.col("x.license").alias("licence"))
    dirs = own.where("license IS NULL AND dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from_dir")))).alias("a")).select("dir", "a.depth", "a.from_dir").distinct()
    near = up.join(files, "from_dir").groupBy("dir").agg(F.max_by(F.struct("licence", "from_dir"), "depth").alias("near"))
    out = own.join(near, "dir", "left")
    none = F.col("license").isNull()
    found = F.when(none & F.col("near").isNotNull(), "inherited").when(none, "none").when(F.col("is_file"), "file").otherwise("header")
    return out.select("doc_id", F.coalesce("license", "near.licence").alias("license"), "score", found.alias("found"), F.when(none, F.col("near.from_dir")).alias("from_dir"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree of files: the source is the top directory, and holds directories of a thousand documents."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return inherit(Scratch(spark, "license").write(own_licences(docs), "own"))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES: dict[str, str] = {}
