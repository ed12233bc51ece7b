"""License scan: sparse TF-IDF cosine of headers to templates, inheritance from the nearest directory above.

A file's own license is the template nearest to one of its header lines or blocks, by the cosine of TF-IDF vectors over
words (A-Z lowered) and pairs of neighbouring words; document frequencies are counted over all distinct header lines and
blocks and the templates. Header lines are lines with a word that only license texts use (HEADER_WORDS); a block is a run of
them with the line above and the line below, ended by a line without letters or digits. Templates are short notices,
standard file headers, SPDX lines and whole licence texts (license_texts/). Licence files are
files whose name says so (LICENSE, LICENCE, COPYING, NOTICE); their whole text is compared as well. A file without a
license of its own takes the one of the nearest directory above it that has a licence file; a directory with several
takes the best match, then the smallest path.

The vectors stay sparse rows (line, term, weight); the cosine is a join on terms and a sum. Equal lines are compared
once. Ancestors are found by joining the directories of a path, one row per level, with directories of licence files.

Results by case: a null or empty text has no license of its own; a null path has no directories; templates tie by name; repeated rows
give repeated results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.store import Stored

THRESHOLD = 0.5
# Notices by which licenses are named in file headers.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal, public domain dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain under the Unlicense.",
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} version {1} as published by the Free Software Foundation."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GENERAL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
EITHER = "Apache-2.0 OR MIT"
# Standard file headers and short licences.
HEADERS = [
    *[(n, _GNU.format(k, v)) for n, k, v in (("GPL-2.0", _GENERAL, "2"), ("GPL-3.0", _GENERAL, "3"), ("LGPL-2.1", _LESSER, "2.1"), ("LGPL-3.0", _LESSER, "3"), ("AGPL-3.0", _AFFERO, "3"))],
    *[(n, _GNU_ONLY.format(k, v)) for n, k, v in (("GPL-2.0", _GENERAL, "2"), ("GPL-3.0", _GENERAL, "3"), ("LGPL-2.1", _LESSER, "2.1"), ("LGPL-3.0", _LESSER, "3"), ("AGPL-3.0", _AFFERO, "3"))],
    ("Apache-2.0", _APACHE), ("Apache-2.0", f"{_APACHE} {_APACHE_END}"), ("Apache-2.0", "Apache License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", _MIT), ("MIT", f"MIT License {_MIT}{_MIT_END}"), ("MIT", "Licensed under the MIT License."), ("MIT", "The MIT License (MIT)"),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-2-Clause", _BSD), ("BSD-3-Clause", _BSD + _BSD_3),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for full license information."), ("MIT", "Distributed under the MIT license."),
    ("BSD-3-Clause", "Distributed under the BSD license."), ("BSD-3-Clause", "Licensed under the BSD license."),
    *[(n, f"Licensed under {x}") for n, x in (("GPL-2.0", "GPLv2"), ("GPL-3.0", "GPLv3"), ("LGPL-2.1", "LGPLv2.1"), ("LGPL-3.0", "LGPLv3"), ("AGPL-3.0", "AGPLv3"))],
    (EITHER, "SPDX-License-Identifier: MIT OR Apache-2.0"), (EITHER, "SPDX-License-Identifier: Apache-2.0 OR MIT"),
    (EITHER, "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
# SPDX identifiers that differ from the license's name.
SPDX = [(n, f"{n}-{x}") for n in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for x in ("only", "or-later")]


def templates() -> list[tuple[str, str]]:
    """(name, text) of every template."""
    whole = [(x.stem, x.read_text(encoding="utf-8")) for x in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    names = sorted({*TEMPLATES, *(n for n, _ in HEADERS)} - {EITHER})
    spdx = [(n, f"SPDX-License-Identifier: {x}") for n, x in [*((n, n) for n in names), *SPDX]]
    return [*TEMPLATES.items(), *HEADERS, *spdx, *whole]


HEADER_WORDS = r"(?i)licen[sc]e|copyright|public\x20domain|spdx|redistribution"
# A text is a licence file by itself if its header blocks hold this share of it.
MOSTLY = 0.5
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)(?:[.-][^/]*)?$"


def _terms(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9.+-]+|[.](?=\\W|$)"), lambda w: w.rlike("[a-z0-9]"))
    bound = F.transform(F.array(words), lambda w: F.concat(w, F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x))))
    return F.get(bound, F.lit(0))


def _blocks(lines: Column) -> Column:
    """Runs of header lines, each with the line above and the line below."""

    def header(x: Column) -> Column:
        return F.coalesce(x.rlike(HEADER_WORDS), F.lit(False))

    def near(w: Column) -> Column:
        around = lambda x, i: x.rlike("[A-Za-z0-9]") & (header(x) | header(F.get(w, i - 1)) | header(F.get(w, i + 1)))
        return F.split(F.array_join(F.transform(w, lambda x, i: F.when(around(x, i), F.translate(x, "\0", " ")).otherwise(F.lit("\0"))), "\n"), "\0")

    runs = F.get(F.transform(F.array(lines), near), F.lit(0))
    return F.filter(runs, lambda x: x.rlike(HEADER_WORDS))


def mostly_license(text: Column) -> Column:
    """True where header lines and what stands next to them make up most of a text; null and texts without such lines are none."""
    held = F.aggregate(_blocks(F.split(text, "\n")), F.lit(0), lambda n, x: n + F.length(x))
    return F.coalesce(F.when(text.rlike(HEADER_WORDS), held >= MOSTLY * F.length(text)), F.lit(False))


def _vectors(counted: DataFrame, frequency: DataFrame, total: Column) -> DataFrame:
    """Unit TF-IDF rows (line, term, weight)."""
    weight = F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    rows = counted.join(frequency, "term", "left").withColumn("total", total).withColumn("weight", weight)
    norms = rows.groupBy("line").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    return rows.join(norms, "line").select("line", "term", (F.col("weight") / F.col("norm")).alias("weight"))


def _counted(lines: DataFrame) -> DataFrame:
    """(line, term, tf); a line is named by its 128-bit hash, as it can be a whole text."""
    return lines.select(F.md5("line").alias("line"), F.explode(_terms(F.col("line"))).alias("term")).groupBy("line", "term").agg(F.count("*").alias("tf"))


def scan(df: DataFrame, path: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """All of df's rows as (all columns but the text, license, cosine, origin).

    origin: 'own', 'inherited' or null; license and cosine are null where nothing applies.
    """
    spark: SparkSession = df.sparkSession
    if clash := {c.lower() for c in df.columns if c != text} & {"license", "cosine", "origin"}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    stored, lasting = Stored(spark), Stored(spark)
    kept = [c for c in df.columns if c != text]
    place = F.col(path).cast("string")
    is_file = F.coalesce(place.rlike(LICENCE_FILE), F.lit(False))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    every = F.split(whole, "\n")
    # most texts have no such word at all and are looked through once
    lines = F.concat(F.filter(every, lambda x: x.rlike(HEADER_WORDS)), _blocks(every))
    lines = F.when(whole.rlike(HEADER_WORDS), lines).otherwise(F.array().cast("array<string>"))
    heads = F.array_distinct(F.transform(F.when(is_file, F.concat(lines, F.array(whole))).otherwise(lines), lambda x: F.trim(x)))
    rows = df.withColumn("__path", place).withColumn("__heads", F.filter(heads, lambda x: x != "")).withColumn("__file", is_file).drop(text)
    rows = stored.keep(rows.withColumn("__row", F.xxhash64("__path", "__heads")), "heads")

    distinct = stored.keep(rows.select(F.explode("__heads").alias("line")).distinct(), "head-lines")
    texts = templates()
    known_texts = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts)], "template int, name string, line string")
    counted = stored.keep(_counted(distinct), "head-terms")
    template_terms = _counted(known_texts.select("line"))
    frequency = counted.unionByName(template_terms).groupBy("term").agg(F.count("*").alias("df"))
    total = F.lit(distinct.count() + len(texts))
    own = _vectors(counted, frequency, total)
    known = _vectors(template_terms, frequency, total).join(known_texts.select("template", "name", F.md5("line").alias("line")), "line").select("template", "name", "term", F.col("weight").alias("known"))
    # at most as many rows as the templates have terms
    cosines = own.join(F.broadcast(known), "term").groupBy("line", "template", "name").agg(F.sum(F.col("weight") * F.col("known")).alias("cosine"))
    best = F.min(F.struct((-F.round("cosine", 9)).alias("c"), "name"))
    first = cosines.where(F.col("cosine") >= threshold).groupBy("line").agg(best.alias("m")).select("line", "m.name", (-F.col("m.c")).alias("cosine"))
    matched = rows.select("__row", F.explode(F.transform("__heads", lambda x: F.md5(x))).alias("line")).distinct().join(first, "line")
    matched = stored.keep(matched.groupBy("__row").agg(best.alias("m")).select("__row", F.col("m.name").alias("own"), (-F.col("m.c")).alias("own_cosine")), "own")
    rows = stored.keep(rows.drop("__heads").join(matched, "__row", "left"), "with-own")

    folder = F.regexp_replace("__path", "/?[^/]*$", "")
    given = rows.where("__file and own is not null").groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("__path").alias("p"), F.col("own").alias("name"))).alias("m"))
    given = given.select("folder", F.col("m.name").alias("name"), (-F.col("m.c")).alias("cosine"))
    steps = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    folders = rows.where("own is null and __path is not null").select(folder.alias("own_folder"), F.array_distinct(above).alias("above")).distinct()
    levels = folders.select("own_folder", F.posexplode("above").alias("depth", "folder"))
    nearest = levels.join(given, "folder").groupBy("own_folder").agg(F.max(F.struct("depth", "name", "cosine")).alias("m"))
    nearest = nearest.select("own_folder", F.col("m.name").alias("inherited"), F.col("m.cosine").alias("inherited_cosine"))
    out = rows.withColumn("own_folder", F.when(F.col("own").isNull(), folder)).join(nearest, "own_folder", "left")
    out = out.select(
        *kept, F.coalesce("own", "inherited").alias("license"), F.round(F.coalesce("own_cosine", "inherited_cosine"), 6).alias("cosine"),
        F.when(F.col("own").isNotNull(), F.lit("own")).when(F.col("inherited").isNotNull(), F.lit("inherited")).alias("origin"),
    )
    result = lasting.keep(out, "licenses")
    stored.drop()
    return result
