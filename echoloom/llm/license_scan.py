"""Licence scans by canonical digest lookup (operator 7), in built-in functions only.

A text is made canonical (case, copyright lines, equivalent spellings, punctuation
and spacing are unified), and the md5 of the whole canonical text is looked up by a hash
join among the digests of known licences.  The units are each document as a whole and
each of its lines as a whole, since notices stand on lines of their own; no
part of a line is ever matched.  Known texts go through the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Public licence texts without their copyright lines.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Licence ids and the names by which notices call them, after SPELLINGS.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "Unlicense": ["Unlicense"],
}
FRAMES = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This software is licensed under the {}", "This project is licensed under the {}", "SPDX-License-Identifier: {}", "License: {}"]
#: Equivalent spellings, lower case, of single-spaced words; replaced inside longer words too ("licences").
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("share alike", "sharealike"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfill", "fulfil")]
#: Digests of whole canonical texts, as their publishers give them, too long to stand here.
WHOLE_DIGESTS = [
    ("d03e86ac7a1ff3f8d928e1d6027bfd17", "Apache-2.0"),
    ("01297679267ad921516667ccd889865e", "Artistic-1.0-Perl"),
    ("93a180096f6cfcf2c0dd24f75c2eec48", "CC0-1.0"),
    ("b2e49d5df14f9afefa31c0beb7580131", "GFDL-1.2"),
    ("e9b317c46c9d0fb48b5d6ded57814eb1", "GFDL-1.3"),
    ("9c1239f6e3721079191b316c150dfa4d", "GPL-1.0"),
    ("7c627f5cbb4a709bc64cbf95da3bcdce", "GPL-2.0"),
    ("a372c7691aaf6b578b9e3e93c8cb85fe", "GPL-3.0"),
    ("6608c762a898a5214a0bdfe43ebccdf0", "LGPL-2.0"),
    ("61babd02f0832750d51cef545886b23e", "LGPL-2.1"),
    ("b31b7335bc37919e8cdd79154e04d88d", "LGPL-3.0"),
    ("153284821273e9b03e87b6cbb85a28a1", "MPL-1.1"),
    ("7d4b8b0889da3c01eff3fe431102e6d6", "MPL-2.0"),
]


def known_texts() -> list[tuple[str, str]]:
    whole = [("MIT", MIT), ("ISC", ISC), ("0BSD", ISC.replace("ISC License", "BSD Zero Clause License").replace(", provided that the above copyright notice and this permission notice appear in all copies", ""))]
    whole += [(name, "\n\n".join([title] * bool(title) + body)) for name, title, body in (("BSD-2-Clause", "BSD 2-Clause License", [BSD_HEAD, BSD_ONE, BSD_TWO, BSD_TAIL]), ("BSD-3-Clause", "BSD 3-Clause License", [BSD_HEAD, BSD_ONE, BSD_TWO, BSD_THREE, BSD_TAIL]))]
    untitled = [(name, text.split("\n\n", 1)[1]) for name, text in whole]
    return whole + untitled + [(name, frame.format(spoken)) for name, spellings in NAMES.items() for spoken in spellings for frame in FRAMES]


def canonical(text: Column) -> Column:
    """Canonical lines, joined by line feeds; copyright lines and blank lines are empty.

    Letters A-Z are lower-cased; whatever is neither an ASCII letter or digit nor beyond
    ASCII parts words; spellings are unified; single spaces remain.
    """
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    out = F.regexp_replace(lower, r"(^|\n)[^a-z0-9\n\x{80}-\x{10FFFF}]*(copyright|©|\(c\))[^\n]*[0-9]{4}[^\n]*", "$1")
    out = F.regexp_replace(out, r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " ")
    for spelled, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelled), F.lit(usual))
    return F.regexp_replace(out, r" *\n *", "\n")


def _whole(lines: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(lines, r"\n+", "\n"), "\n", " "))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id), one row for each canonical text: those of ``texts``, or all that are known here."""
    rows = spark.createDataFrame(texts if texts is not None else known_texts(), "license_id string, text string")
    listed = rows.select(F.md5(_whole(canonical(F.col("text")))).alias("digest"), "license_id")
    if texts is None:
        listed = listed.unionByName(spark.createDataFrame(WHOLE_DIGESTS, "digest string, license_id string"))
    return listed.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Every whole text and whole line that is a known licence or licence notice.

    Returns ``doc_id``, ``scope`` (``text`` or ``line``), ``line_no`` (from 1; 0 for the text),
    ``license_id`` and ``digest``; a document of one line is given once, as a text.  Null,
    empty and blank texts match nothing; repeated rows are each given; rows with a
    null doc_id are scanned too.  Only the two columns ``doc_id`` and ``text`` are read.
    """
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known  # the list above, some 400 rows
    lines = docs.select("doc_id", canonical(F.col("text")).alias("lines")).select("doc_id", F.transform(F.split("lines", "\n"), lambda x: F.trim(x)).alias("lines"))
    whole = F.array_join(F.filter("lines", lambda x: x != ""), " ")
    several = F.size(F.filter("lines", lambda x: x != "")) > 1
    units = F.concat(F.array(whole), F.when(several, F.col("lines")).otherwise(F.array().cast("array<string>")))
    # The outer form: else Catalyst infers a filter on the units' number and computes them once more for it.
    found = lines.select("doc_id", units.alias("units")).select("doc_id", F.posexplode_outer("units").alias("line_no", "unit")).where("unit <> ''")
    found = found.select("doc_id", "line_no", F.md5("unit").alias("digest")).join(known, "digest")
    return found.select("doc_id", F.when(F.col("line_no") == 0, "text").otherwise("line").alias("scope"), F.col("line_no").cast("long").alias("line_no"), "license_id", "digest")
