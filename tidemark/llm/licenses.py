"""License scans (operator 10): sparse TF-IDF cosine to templates, then inheritance by directory.

Terms are lower-cased words. Document frequencies of the templates' terms are counted over the whole
corpus; words outside the templates weigh as much as the rarest term. Around each word that speaks
of licensing, windows of words are compared with every template; a document's header license is
the best one of at least LEAST. A licence file (one named like it, or a text that as a whole reaches
LEAST_FILE) speaks for its directory, and a document without a license takes that of its nearest
ancestor directory that has one, found by joining the directories' ancestor paths.

Defined cases: null or empty texts have no license; ties go to the license that sorts first;
several licence files of a directory give the one of the highest score, then the one that sorts
first; a null path has no
directory, so it inherits nothing; repeated rows are treated alike; an empty table gives no row;
whole texts are read; other columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, many_to_one, small_batches

# Short forms of well-known licenses' notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License"
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files"
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License"
    ),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, "
        "are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License"
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License"
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"
    ),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
#: Whole texts, which a document as a whole is compared with besides the notices.
FILES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
FILE_NAMES = r"(?i)^(?:un)?licen[cs]e(?:[.-].*)?$|^copying(?:\..*)?$|^notice(?:\..*)?$"
LEAST, LEAST_FILE = 0.75, 0.8
OUTPUT = ("license", "score", "origin", "licensed_by")
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_NEAR = re.compile(r"licen[cs]e|copyright|public domain|redistribut|permission|creative commons")
_ANCHOR = re.compile(r"(?:un)?licen[cs]e.*|copyright.*|redistribut.*|domain|commons|permission|subject")
_BEFORE, _AFTER = (0, 1, 2, 3, 4, 5, 6, 8, 12), (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 30)


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Model:
    def __init__(self, df: dict[str, int], n: int, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.top = math.log(1 + n) + 1
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for ts in templates.values() for x in ts for t in terms(x)}
        self.templates = [
            (name, w, math.sqrt(sum(v * v for v in w.values())))
            for name, ts in sorted(templates.items())
            for w in (self.weights(terms(x)) for x in ts)
        ]
        self.files = [
            (name, w, math.sqrt(sum(v * v for v in w.values())))
            for name, w in ((name, self.weights(terms(x))) for name, x in sorted(FILES.items()))
        ]

    def weights(self, words: list[str]) -> dict[str, float]:
        return {t: (1 + math.log(c)) * self.idf.get(t, self.top) for t, c in Counter(words).items()}

    def best(self, words: list[str], whole: bool = False) -> tuple[float, str]:
        w = self.weights(words)
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        out = (0.0, "")
        for name, t, size in self.templates + self.files if whole else self.templates:
            s = sum(v * w[k] for k, v in t.items() if k in w) / norm / size
            if s > out[0] + 1e-12:
                out = (s, name)
        return out

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """(license, cosine of the best window, cosine of the whole text)."""
        low = (text or "").lower()
        if not _NEAR.search(low):
            return None, 0.0, 0.0
        words = terms(low)
        out = (0.0, "")
        seen: set[tuple[str, ...]] = set()  # a window that repeats has the cosine it had
        for i, w in enumerate(words):
            if _ANCHOR.fullmatch(w):
                for window in {tuple(words[max(0, i - a) : i + b]): None for a in _BEFORE for b in _AFTER}:
                    if window not in seen:
                        seen.add(window)
                        got = self.best(list(window))
                        if got[0] > out[0] + 1e-12 or (got[0] > out[0] - 1e-12 and out[1] and got[1] < out[1]):
                            out = got
        whole = self.best(words, whole=True)[0]
        return (out[1] if out[0] >= LEAST else None), out[0], whole


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Document frequencies of the templates' terms over all documents."""
    small_batches(docs.sparkSession)
    vocabulary = frozenset(t for ts in TEMPLATES.values() for x in ts for t in terms(x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c[""] += 1
                if t:
                    found = {w.strip(".,;:!?()[]\"'*#&$%|") for w in set(t.lower().split())}
                    c.update(vocabulary & found)
        yield pa.RecordBatch.from_pydict({"t": list(c), "n": pa.array(c.values(), pa.int64())})

    # The vocabulary at most.
    rows = docs.select(text).mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n")).collect()
    df = {r[0]: r[1] for r in rows}
    return Model(df, df.pop("", 0))


def scan(files: DataFrame, model: Model, path: str = "path", text: str = "text") -> DataFrame:
    """files with license, score, origin ("header", "file", "inherited" or "none") and licensed_by,
    the directory that an inherited license comes from; without the text. Columns of files that have
    one of these names are replaced."""
    spark = files.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("license string, score double, whole double")
    def of(texts):
        import pandas as pd

        return pd.DataFrame([shared.value.scan(t) for t in texts.tolist()], columns=["license", "score", "whole"])

    kept = [c for c in files.columns if c not in (text, *OUTPUT)]
    where = F.col(path).cast("string")
    rows = files.select(F.struct(*(F.col(c) for c in kept)).alias("own"), where.alias("path"), of(F.col(text)).alias("scan"))
    rows = cut(rows)  # written once, as three plans read it
    folder = F.when(F.col("path").isNotNull(), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("dir")
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1)
    is_file = F.col("scan.license").isNotNull() & (name.rlike(FILE_NAMES) | (F.col("scan.whole") >= LEAST_FILE))
    rows = rows.select("own", "scan", folder, is_file.alias("file"))
    best = F.min_by("scan.license", F.struct(-F.col("scan.score"), F.col("scan.license")))
    spoken = rows.where("file and dir is not null").groupBy("dir").agg(best.alias("taken"))
    # Every directory's ancestors, itself included, nearest first; distinct directories only.
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    sizes = rows.where("dir is not null").groupBy("dir").agg(F.count("*").alias("files"))
    sizes = cut(sizes)
    up = sizes.select("dir", F.explode(ancestors).alias("at"))
    below = up.groupBy("at").agg(F.count("*").alias("below"))
    speaking = spoken.withColumnRenamed("dir", "at").join(below, "at")
    total = sizes.agg(F.count("*"), F.coalesce(F.sum("files"), F.lit(0))).first()
    told = many_to_one(up, cut(speaking), ["at"], "below", total[0]).where("taken is not null")
    nearest = told.groupBy("dir").agg(F.max_by(F.struct("taken", "at"), F.length("at")).alias("from"))
    nearest = cut(nearest.join(sizes, "dir"))
    got = many_to_one(rows, nearest, ["dir"], "files", total[1])
    mine = F.col("scan.license").isNotNull()
    inherited = F.col("from").isNotNull()
    return got.select(
        *(F.col("own")[c].alias(c) for c in kept),
        F.coalesce("scan.license", "from.taken").alias("license"),
        F.when(mine, F.col("scan.score")).otherwise(0.0).alias("score"),
        F.when(F.col("file"), "file").when(mine, "header").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(~mine & inherited, F.col("from.at")).alias("licensed_by"),
    )
