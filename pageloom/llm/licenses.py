"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, inherited along paths. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm.common import stored, text_or_empty

_AS_IS = """is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability,
fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other
liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings
in the software."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_AS_IS = """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to,
the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be
liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods
or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability,
or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain
a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free
Software Foundation, either version {} of the License, or (at your option) any later version."""
_GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public License for more details."""
_GPL_END = "You should have received a copy of the GNU {} Public License along with this program. If not, see http://www.gnu.org/licenses/"


def _gnu(kind: str, version: str, short: str, title: str) -> tuple[str, ...]:
    head = _GPL.format(kind, version)
    return (
        f"This work is licensed under the GNU {kind} Public License, version {version}.",
        f"GNU {kind} Public License Version {version}, {title}",
        head, f"{head} {_GPL_REST.format(kind)} {_GPL_END.format(kind)}", f"spdx{short}",
    )


def _cc(kind: str, long: str, short: str) -> tuple[str, ...]:
    return f"Licensed under CC {kind} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"spdx{short}"


#: Licence -> wordings of its notices, headers, first paragraphs and file, and its SPDX token; a parameter
#: of the operator.
TEMPLATES = {
    "GPL-3.0": _gnu("General", "3", "gpl30", "29 June 2007"),
    "GPL-2.0": _gnu("General", "2", "gpl20", "June 1991"),
    "LGPL-3.0": _gnu("Lesser General", "3", "lgpl30", "29 June 2007"),
    "LGPL-2.1": _gnu("Lesser General", "2.1", "lgpl21", "February 1999"),
    "AGPL-3.0": _gnu("Affero General", "3", "agpl30", "19 November 2007"),
    "MIT": ("Released under the MIT License.", "MIT License", _MIT, f"MIT License Copyright (c) {_MIT} {_MIT_REST} The software {_AS_IS}", "spdxmit"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", _APACHE, f"{_APACHE} {_APACHE_REST}",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "spdxapache20",
    ),
    "BSD-2-Clause": (f"Copyright (c) All rights reserved. {_BSD} {_BSD_2} {_BSD_AS_IS}", "Released under the BSD 2-Clause License.", "spdxbsd2clause"),
    "BSD-3-Clause": (f"Copyright (c) All rights reserved. {_BSD} {_BSD_2} {_BSD_3} {_BSD_AS_IS}", "Released under the BSD 3-Clause License.", "spdxbsd3clause"),
    "MPL-2.0": (
        "This work is subject to the terms of the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""", "spdxmpl20",
    ),
    "ISC": (
        """ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all
warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any
special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract,
negligence or other tortious action, arising out of or in connection with the use or performance of this software.""", "spdxisc",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "spdxunlicense"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial", "ccbync40"),
    "CC-BY-4.0": _cc("BY", "Attribution", "ccby40"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike", "ccbysa40"),
}
SIGNS = "(?i)licen[cs]|copyright|spdx|all rights reserved|permission is hereby granted|redistribution and use|public domain"
#: What shows that a whole text may be a licence file or that its header has a licence's terms.
BODY = "(?i)permission is hereby granted|permission to use, copy|redistribution and use|as published by the free software|(?:you )?may not use this file except"
SPDX = "(?i)spdx-license-identifier:[ ]*[(]?([a-z0-9.+-]+)"
LICENCE_FILE = "(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)(?:[-._][^/]*)?$"
LEAST = 0.75


def spdx_token(identifier: Column) -> Column:
    """One term for an identifier, so that only the same one is near: versions that may be later count as the version."""
    bare = F.regexp_replace(F.lower(identifier), "-or-later$|-only$|[+]$", "")
    return F.concat(F.lit("spdx"), F.regexp_replace(bare, "[^a-z0-9]", ""))


def units(text: Column) -> Column:
    """What is compared with the templates: each line that shows a licence sign (an SPDX line as its identifier's term),
    each paragraph of several lines that shows one, and a whole text that has a licence's terms."""
    shown = lambda xs: F.filter(xs, lambda x: x.rlike(SIGNS))
    lines = F.transform(shown(F.split(text, "\n")), lambda x: F.when(x.rlike(SPDX), spdx_token(F.regexp_extract(x, SPDX, 1))).otherwise(F.btrim(x)))
    parts = F.split(text, r"\n[ \t/#*;-]*\n")
    parts = F.transform(shown(F.filter(parts, lambda x: x.contains("\n"))), F.btrim)
    whole = F.when(text.rlike(BODY) & (F.size(F.split(text, r"\n[ \t/#*;-]*\n")) > 1), F.array(F.btrim(text))).otherwise(F.array().cast("array<string>"))
    return F.when(text.rlike(SIGNS), F.concat(lines, parts, whole)).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def line_matches(lines: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """key, licence, cosine for each distinct line (columns key, line, n: its rows) that is near enough to a wording.

    Weights are (count of the term) * (1 + ln((1+N)/(1+df))), N and df over all rows of lines. The best wording wins, the
    first licence by name on a tie at six places.
    """
    spark: SparkSession = lines.sparkSession
    total = lines.agg(F.sum("n")).first()[0] or 0
    tf = lines.select("key", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    tf = stored(tf, "licence-terms")
    df = stored(tf.groupBy("term").agg(F.sum("n").alias("df")), "licence-df")
    idf = 1 + F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0))))
    wordings = [F.struct(F.lit(k).alias("licence"), F.lit(i).alias("i"), F.lit(w).alias("wording")) for k, ws in sorted(templates.items()) for i, w in enumerate(ws)]
    words = spark.range(1).select(F.explode(F.array(*wordings)).alias("t")).select("t.licence", "t.i", F.explode(terms(F.col("t.wording"))).alias("term"))
    words = words.groupBy("licence", "i", "term").agg(F.count("*").alias("tf"))
    words = stored(words.join(df, "term", "left").select("licence", "i", "term", (F.col("tf") * idf).alias("wt")), "licence-wordings")
    norm = words.groupBy("licence", "i").agg(F.sqrt(F.sum(F.col("wt") * F.col("wt"))).alias("nt"))
    weighed = stored(tf.join(df, "term").select("key", "term", (F.col("tf") * idf).alias("wl")), "licence-weights")
    length = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("wl") * F.col("wl"))).alias("nl"))
    # the templates are a parameter, so their terms are few
    dot = weighed.join(F.broadcast(words), "term").groupBy("key", "licence", "i").agg(F.sum(F.col("wl") * F.col("wt")).alias("dot"))
    scored = dot.join(F.broadcast(norm), ["licence", "i"]).join(length, "key").withColumn("cosine", F.round(F.col("dot") / (F.col("nl") * F.col("nt")), 6))
    best = F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), "licence"))
    return scored.filter(F.col("cosine") >= least).groupBy("key").agg(best.alias("b")).select("key", "b.licence", "b.cosine")


def licences(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, path, licence, cosine, origin (own, inherited or none), from_dir of every row of docs (doc_id, path, text).

    units() of a text are compared with the wordings; the best one near enough names the text's own licence. A text with
    one also rules its directory: a file whose name is that of a licence file before all others, then the smallest doc_id,
    then the first path and licence. A text without one takes that of the nearest directory above it; the root is the
    directory ''. Null and empty texts, null paths and directories without a licence give none. Repeated rows get the same
    answer, and other columns of docs don't matter. Of an SPDX expression the first identifier counts.
    """
    docs = docs.select("doc_id", "path", "text")
    heads = docs.select("doc_id", "path", F.explode(units(text_or_empty())).alias("line"))
    heads = stored(heads.withColumn("key", F.unhex(F.md5("line"))), "licence-heads")
    lines = heads.groupBy("key").agg(F.first("line").alias("line"), F.count("*").alias("n"))
    found = stored(line_matches(lines, templates, least), "licence-lines")
    own = heads.select("doc_id", "path", "key").join(found, "key").groupBy("doc_id", "path").agg(F.min_by(F.struct("licence", "cosine"), F.struct(-F.col("cosine"), "licence")).alias("own"))
    own = stored(own, "licence-own")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    ruled = own.filter("path is not null").groupBy(parent.alias("dir")).agg(F.min_by(F.struct("own.licence", "own.cosine"), F.struct(~F.col("path").rlike(LICENCE_FILE), F.col("doc_id").isNull(), "doc_id", "path", "own.licence")).alias("rule"))
    ruled = stored(ruled, "licence-dirs")
    # directories above each path; a directory asks once for all its documents
    dirs = docs.filter("path is not null").select(parent.alias("at")).distinct()
    ups = dirs.select("at", F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split("at", "/"))), lambda i: F.array_join(F.slice(F.split("at", "/"), 1, i), "/"))).alias("dir"))
    near = ups.join(ruled, "dir").groupBy("at").agg(F.max_by(F.struct("dir", "rule"), F.length("dir")).alias("near"))
    near = stored(near, "licence-near")
    rows = docs.select("doc_id", "path", parent.alias("at")).join(own, [docs.doc_id.eqNullSafe(own.doc_id), docs.path.eqNullSafe(own.path)], "left").select(docs.doc_id, docs.path, "at", "own")
    rows = rows.join(near, "at", "left")
    pick = lambda f: F.coalesce(F.col(f"own.{f}"), F.col(f"near.rule.{f}"))
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return rows.select("doc_id", "path", pick("licence").alias("licence"), pick("cosine").alias("cosine"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("near.dir")).alias("from_dir"))


def digit_path(source: Column, doc_id: Column) -> Column:
    """A path for tables without one: source, then the prefixes of the number, as in src1/1/12/123."""
    text = doc_id.cast("string")
    return F.concat_ws("/", F.coalesce(source, F.lit("-")), F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, F.lit(1), i)), "/"))
