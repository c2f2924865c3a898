"""License scans: TF-IDF cosine to templates, then inheritance by directory.

Every run of adjacent lines of a file that has no more words than ``RUN_FACTOR``
times the longest template (a header may stand anywhere, wrapped at any width)
and the file as a whole are compared with the
templates by the cosine of sparse vectors over words, weighted by inverse
document frequency. In a run a word weighs by its count; in a whole file by one
plus the logarithm of its count, since in a long text plain counts say how
often the commonest words stand there. The templates are notices, standard
headers, the short licence texts and, for whole files only, the long ones. A
file with a run at or above ``line_cosine``, or with an SPDX tag that names one
of the licences, states its licence itself. A file that as a whole
reaches ``file_cosine`` is a licence file and speaks for its directory. A file
that states none inherits from the licence file in the nearest ancestor
directory, its own first.

Document frequencies of all words are counted over all files (a partial
aggregate) and stay a table, which words meet by a join. Only texts that can
reach a threshold take that path: the rarest words of a template, taken until
the rest of its vector is too short for the threshold, are needed words, and a
text without any of them cannot reach it, whatever else it holds. This loses no
file: the bound is exact. Runs are pruned the same way: products add up over
lines and squared lengths grow at least as their sum, so the sums bound the
cosine, and only runs that they leave are counted word by word. Repeated texts are scored once. The words of a hot key ("the")
are narrow rows after a partial aggregate, whose join AQE splits.

Inheritance works on distinct directories: each is exploded into its ancestors,
joined with the licence files' directories, reduced to the deepest one by a
partial aggregate, and joined back; a directory with a third of all files is
one row until that last join, which AQE can split.

Defined results: null and empty texts state nothing and inherit; a null path
counts as the root directory; of several licence files in a directory the best
cosine speaks, then the last name; rows that repeat are scored alike; an SPDX tag
counts as cosine 1, of an expression the first name counts; without
any licence file nothing is inherited; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import empty_if_null, forget, stored

# fixed values: short public licence notices, by SPDX-style name
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_START = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published
by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."""
_GNU_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_CC = """Creative Commons {0} 4.0 International Public License
By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this
Creative Commons {0} 4.0 International Public License ("Public License"). To the extent this Public License may be interpreted
as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the
Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available
under these terms and conditions."""
_CC_VIEW = """This work is licensed under the Creative Commons {0} 4.0 International License. To view a copy of this license,
visit http://creativecommons.org/licenses/{1}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""


def _gnu(kind: str, version: str, short: str) -> list[str]:
    start, end = _GNU_START.format(kind, version), _GNU_END.format(kind)
    return [start, start + "\n" + end, f"Licensed under the GNU {kind}, version {version}.", f"Licensed under the {short} license."]


#: further wordings: sentences, standard headers, short licence texts; neighbours of a licence keep it from taking their files
FURTHER = {
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
        "This project is licensed under the Apache License 2.0."],
    "BSD-2-Clause": [_BSD_START + "\n" + _BSD_END, "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["\n".join([_BSD_START, _BSD_NAME, _BSD_END]), "Licensed under the BSD 3-Clause License.",
                     "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": [_CC.format("Attribution"), _CC_VIEW.format("Attribution", "by"), "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": [_CC.format("Attribution-NonCommercial"), _CC_VIEW.format("Attribution-NonCommercial", "by-nc"),
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-2.0": _gnu("General Public License", "2", "GPL-2.0"),
    "GPL-3.0": _gnu("General Public License", "3", "GPL-3.0"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "LGPL-2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "LGPL-3.0"),
    "MIT": [_MIT_TEXT, "Licensed under the MIT License.", "This project is licensed under the MIT License.",
            "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "MPL-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
                "Licensed under the Mozilla Public License 2.0."],
}
#: words of a run of lines, in words of the longest template for runs; long licence texts are compared with whole files only
RUN_FACTOR = 1.4
TEXTS = Path(__file__).parent / "license_texts"
SPDX = re.compile(r"(-only|-or-later|\+)?$")


def _long_texts() -> list[tuple[str, str]]:
    return [(p.stem, p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]


def spdx_tag(text: Column, names: list[str]) -> Column:
    """Struct (cosine, license) of the SPDX tags that name a known licence, or null."""
    known = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    tags = F.regexp_extract_all(text, F.lit(r"(?i)SPDX-License-Identifier:\s*\(*([a-z0-9.+-]+)"), 1)
    bare = F.transform(tags, lambda t: F.element_at(known, F.regexp_replace(F.lower(t), SPDX.pattern, "")))
    found = F.filter(bare, lambda n: n.isNotNull())
    has = F.lower(text).contains("spdx-license-identifier") & (F.size(found) > 0)
    return F.when(has, F.struct(F.lit(1.0).alias("cosine"), F.array_max(found).alias("license")))


def template_words(text: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", text.lower()))


def words(text: Column) -> Column:
    """Words of a text (ASCII letters in lower case, and digits)."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _damped(count: Column) -> Column:
    return F.log(count) + 1


def frequencies(files: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, df): in how many files each word stands."""
    found = files.select(F.explode(F.array_distinct(words(empty_if_null(F.col(text_col))))).alias("w"))
    return stored(found.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "document_frequencies")


class Vectors:
    """The templates as vectors of their words' weights; the first ``short`` of them are for runs of lines too."""

    def __init__(self, templates: list[tuple[str, str]], short: int, df: dict[str, int], n: int):
        self.names = [name for name, _ in templates]
        counts = [template_words(t) for _, t in templates]
        idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for c in counts for w in c}
        self.df = df
        self.plain = [{w: k * idf[w] for w, k in c.items()} for c in counts[:short]]
        self.damped = [{w: (math.log(k) + 1) * idf[w] for w, k in c.items()} for c in counts]
        self.run_words = math.ceil(RUN_FACTOR * max(c.total() for c in counts[:short]))

    def needed(self, vectors: list[dict[str, float]], cosine: float) -> set[str]:
        """Words of which a text must hold one to reach the cosine with any template."""
        out = set()
        for v in vectors:
            own = sum(x * x for x in v.values())
            rest = own
            for w in sorted(v, key=lambda w: (self.df.get(w, 0), w)):
                if rest <= max(cosine - 1e-6, 0) ** 2 * own:
                    break
                out.add(w)
                rest -= v[w] ** 2
        return out

    def table(self, files: DataFrame) -> DataFrame:
        """(w, plain, damped): the weights of a word in all templates; as many rows as the templates have words."""
        every = sorted({w for v in self.damped for w in v})
        rows = [(w, [v.get(w, 0.0) for v in self.plain], [v.get(w, 0.0) for v in self.damped]) for w in every]
        return files.sparkSession.createDataFrame(rows, "w string, plain array<double>, damped array<double>")

    def dots(self, weights: str) -> list[Column]:
        """Sums of products of ``x`` with each template's column of weights."""
        n = len(self.plain if weights == "plain" else self.damped)
        return [F.sum(F.coalesce(F.col("x") * F.col(weights)[t], F.lit(0.0))).alias(f"d{t}") for t in range(n)]

    def best(self, vectors: list[dict[str, float]], square: Column) -> Column:
        """Struct (cosine, license) from the products and the squared length."""
        out = []
        for t, v in enumerate(vectors):
            own = sum(x * x for x in v.values())
            cosine = F.when(square > 0, F.round(F.col(f"d{t}") / F.sqrt(square * own), 9)).otherwise(0.0)
            out.append(F.struct(cosine.alias("cosine"), F.lit(self.names[t]).alias("license")))
        return F.array_max(F.array(*out))


def _runs(lines: DataFrame, vectors: Vectors, cosine: float) -> DataFrame:
    """(key, s, e): runs of two lines or more, and no more words than a header, that can reach the cosine.

    ``lines`` holds each line's number of words, squared length ``sq``, products ``d0``, ``d1``... and ``hit``,
    whether it has a needed word. The first and the last line of a best run share words with its template.
    """
    ds = [f"d{t}" for t in range(len(vectors.plain))]
    most = vectors.run_words
    ordered = Window.partitionBy("key").orderBy("i")
    placed = lines.withColumn("to", F.sum("words").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    around = Window.partitionBy("key").orderBy("to").rangeBetween(-most, most)
    near = placed.withColumn("near", F.max("hit").over(around)).filter("near").withColumn("shares", F.greatest(*ds) > 0)
    # lines by rank; ``back`` counts those that a run may hold besides the last one (whose words go off the limit)
    within = Window.partitionBy("key").orderBy("to").rangeBetween(-most, 0)
    ranked = (near.withColumn("r", F.row_number().over(ordered)).withColumn("back", F.count(F.lit(1)).over(within) - 1)
                  .select("key", "i", "r", "back", "shares", "hit", "sq", "words", *ds))
    spread = ranked.withColumn("s", F.explode(F.sequence(F.col("r") - F.col("back").cast("int"), F.col("r"))))
    run = Window.partitionBy("key", "s").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    sums = spread.select("key", F.first("i").over(run).alias("s"), F.col("i").alias("e"), "shares", F.max("hit").over(run).alias("hit"),
                         (F.first("shares").over(run) & (F.first("r").over(run) == F.col("s"))).alias("starts"),
                         F.sum("words").over(run).alias("words"), F.sum("sq").over(run).alias("sq"),
                         *[F.sum(d).over(run).alias(d) for d in ds])
    able = vectors.best(vectors.plain, F.col("sq"))["cosine"] >= cosine - 1e-6
    return (sums.filter((F.col("s") < F.col("e")) & (F.col("words") <= most) & F.col("starts") & F.col("shares") & F.col("hit") & able)
                .select("key", "s", "e"))


def _scores(texts: DataFrame, vectors: Vectors, df: DataFrame, n: int, cosine: float) -> tuple[DataFrame, list[DataFrame]]:
    """(key, line, whole): best template of a text's runs of lines and of the whole text; and the tables it reads."""
    lines = texts.select("key", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    counts = (lines.select("key", "i", F.explode(words(F.col("line"))).alias("w"))
                   .groupBy("key", "i", "w").agg(F.count(F.lit(1)).alias("k")))
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    tokens = stored(counts.join(df, "w").select("key", "i", "w", "k", idf.alias("idf")), "license_words")
    table = F.broadcast(vectors.table(texts))

    def squared(units: DataFrame, weights: str, *by: str, also: tuple[Column, ...] = ()) -> DataFrame:
        return units.join(table, "w", "left").groupBy(*by).agg(F.sum(F.col("x") * F.col("x")).alias("sq"), *vectors.dots(weights), *also)
    best = vectors.best(vectors.plain, F.col("sq")).alias("best")
    weighed = tokens.withColumn("x", F.col("k") * F.col("idf"))
    hit = F.max(F.col("w").isin(*vectors.needed(vectors.plain, cosine))).alias("hit")
    lines = stored(squared(weighed, "plain", "key", "i", also=(hit, F.sum("k").alias("words"))), "license_lines")
    runs = stored(_runs(lines, vectors, cosine), "license_runs")
    inside = (runs.withColumn("i", F.explode(F.sequence("s", "e"))).join(weighed.select("key", "i", "w", "x"), ["key", "i"])
                  .groupBy("key", "s", "e", "w").agg(F.sum("x").alias("x")))
    single = (lines.select("key", best).unionByName(squared(inside, "plain", "key", "s", "e").select("key", best))
                   .groupBy("key").agg(F.max("best").alias("line")))
    whole = (squared(tokens.groupBy("key", "w").agg(F.sum("k").alias("k"), F.first("idf").alias("idf"))
                           .withColumn("x", _damped(F.col("k")) * F.col("idf")), "damped", "key")
             .select("key", vectors.best(vectors.damped, F.col("sq")).alias("whole")))
    return single.join(whole, "key"), [tokens, lines, runs]


def scan(files: DataFrame, templates: dict[str, str | list[str]] | None = None, line_cosine: float = 0.8, file_cosine: float = 0.5,
         id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id, path, license, cosine, how): ``how`` is 'header', 'inherited' or null."""
    given = templates or {n: [*([TEMPLATES[n]] if n in TEMPLATES else []), *FURTHER.get(n, [])] for n in {**TEMPLATES, **FURTHER}}
    pairs = sorted((n, t) for n, ts in given.items() for t in ([ts] if isinstance(ts, str) else ts))
    short, pairs = len(pairs), pairs + ([] if templates else _long_texts())
    src = files.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"),
                       empty_if_null(F.col(text_col)).alias("text"))
    df, n = frequencies(src), src.count()
    vocabulary = {w for _, t in pairs for w in template_words(t)}
    known = {r["w"]: r["df"] for r in df.filter(F.col("w").isin(*vocabulary)).collect()}  # one row per template word
    vectors = Vectors(pairs, short, known, n)
    needed = vectors.needed(vectors.plain, line_cosine) | vectors.needed(vectors.damped, file_cosine)
    near = F.arrays_overlap(words(F.col("text")), _literals(sorted(needed)))
    rows = stored(src.select("id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
                             spdx_tag(F.col("text"), sorted(given)).alias("tag"),
                             F.when(near, F.sha2("text", 256)).alias("key"), F.when(near, F.col("text")).alias("text")), "licenses")
    texts = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.first("text").alias("text"))
    scores, used = _scores(texts, vectors, df, n, line_cosine)
    scores = stored(scores, "license_scores")
    forget(df, *used)
    rows = rows.drop("text")
    scored = (rows.filter(F.col("key").isNotNull()).join(scores, "key", "left")
                  .unionByName(rows.filter(F.col("key").isNull()), allowMissingColumns=True)
                  .withColumn("line", F.array_max(F.array("line", "tag"))).drop("key", "tag"))

    rank = F.struct("whole.cosine", F.col("whole.license"))
    speaks = (scored.filter(F.col("whole.cosine") >= file_cosine).groupBy("dir")
                    .agg(F.max(rank).alias("best"))
                    .select(F.col("dir").alias("at"), F.col("best.license").alias("license"), F.col("best.cosine").alias("cosine")))
    # every distinct directory with all its ancestors; '' is the root
    steps = F.filter(F.split("dir", "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)),
                        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, F.lit(1), i), "/").alias("at")))
    chains = scored.select("dir").distinct().select("dir", F.inline(above))
    nearest = (chains.join(speaks, "at").groupBy("dir")
                     .agg(F.max(F.struct("depth", "license", "cosine")).alias("from")))
    out = scored.join(nearest, "dir", "left")
    own = F.col("line.cosine") >= line_cosine
    return out.select(
        "id", "path",
        F.when(own, F.col("line.license")).otherwise(F.col("from.license")).alias("license"),
        F.when(own, F.col("line.cosine")).otherwise(F.col("from.cosine")).alias("cosine"),
        F.when(own, F.lit("header")).when(F.col("from").isNotNull(), F.lit("inherited")).alias("how"))
