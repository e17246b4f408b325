"""Licence scan by canonical digest.

A text is brought to a canonical form in which differences that have no legal meaning
are gone, and its digest is joined with the digests of known licences brought to the
same form. Whole texts are matched, and so is every line, for the one-line notices
that sources carry. All steps are SQL functions; texts do not enter a shuffle.
"""

from __future__ import annotations

import re
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import cut

#: Whole licence texts as they are published, a file for each. Fixed values.
TEXTS = {path.stem: path.read_text(encoding="utf-8")
         for path in sorted((Path(__file__).parent / "licences").glob("*.txt"))}

#: Spellings with one meaning: every left form is written as the right one. Applied to
#: lower-case text in this order. Fixed values, from the public matching guidelines
#: for licence texts.
SPELLINGS = (
    *((c, "'") for c in "\u2018\u2019\u201a\u201b\u2032"),
    *((c, '"') for c in "\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb"),
    *((c, "-") for c in "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"), ("\u00a0", " "),
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"),
    ("authoris", "authoriz"), ("behaviour", "behavior"), ("catalogue", "catalog"),
    ("centre", "center"), ("customis", "customiz"), ("favour", "favor"),
    ("fulfil ", "fulfill "), ("honour", "honor"), ("initialis", "initializ"),
    ("judgement", "judgment"), ("labour", "labor"), ("non-infringement", "noninfringement"), ("organis", "organiz"), ("practise", "practice"),
    ("recognis", "recogniz"), ("sub-license", "sublicense"), ("utilis", "utiliz"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright holder", "copyright owner"),
    ("per cent", "percent"), ("https", "http"),
)

#: A line that only states a copyright.
_COPYRIGHT = r"(?md)^[^a-z0-9\n]*(?:\(c\)|©|copyright (?:\(c\)|©|[0-9]))[^\n]*$"

_PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Known licence texts and one-line notices. Fixed values.
KNOWN = (
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "text", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", "text", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "notice", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "notice", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "notice", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
)

#: Names of licences in notices, by identifier. Fixed values.
_NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License Version 2.0", "Apache License 2.0",
                   "Apache 2.0 License", 'Apache License, Version 2.0 (the "License")'),
    "MIT": ("MIT License", "MIT licence (MIT)"),
    "ISC": ("ISC License",),
    "0BSD": ("Zero-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
}
_WORDINGS = ("Licensed under", "Licensed under the", "Licensed under a", "Released under the", "Released under",
             "Distributed under the", "Available under the", "This work is licensed under a",
             "This work is licensed under the", "This project is licensed under the",
             "This software is licensed under the", "License:")

KNOWN += tuple((name, "notice", f"{wording} {title}") for name, titles in _NAMES.items()
               for title in titles for wording in _WORDINGS)
KNOWN += tuple((name, "notice", f"SPDX-License-Identifier: {name}{end}") for name in _NAMES
               for end in (("", "-only", "-or-later") if "GPL" in name else ("",)))

_RIGHTS = ("", "All rights reserved.\n")

#: Usual titles of the short licences. Fixed values.
_TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)",
            "Expat License"),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("", "0BSD", "Zero-Clause BSD", "BSD Zero Clause License",
             "BSD Zero Clause License (0BSD)", "Zero-Clause BSD (0BSD)"),
    "BSD-2-Clause": ("", "BSD License", "BSD 2-Clause License", "The BSD 2-Clause License",
                     'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("", "BSD License", "BSD 3-Clause License", "The BSD 3-Clause License",
                     'BSD 3-Clause "New" or "Revised" License', "New BSD License"),
}


def _short_texts():
    for name, kind, text in KNOWN[:3]:
        texts = [text]
        if name == "MIT":
            texts.append(text.replace("this permission notice shall",
                                      "this permission notice (including the next paragraph) shall"))
        elif name == "ISC":
            texts.append(text.replace("modify, and/or distribute", "modify, and distribute"))
        yield from ((name, kind, t) for t in texts)
    conditions = (
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.")
    promote = ("be used to endorse or promote products derived from this software without "
               "specific prior written permission.")
    for third, (by, liable), bullets in product(
            ("", f"Neither the name of the copyright holder nor the names of its contributors may {promote}",
             f"Neither the name of the University nor the names of its contributors may {promote}",
             f"The name of the author may not {promote}"),
            (("copyright holders and contributors", "copyright holder or contributors"),
             ("copyright holders and contributors", "copyright holders or contributors"),
             ("regents and contributors", "regents or contributors"),
             ("author and contributors", "author or contributors"), ("author", "author")),
            (("1. ", "2. ", "3. "), ("* ", "* ", "* "))):
        listed = "\n".join(b + c for b, c in zip(bullets, (*conditions, third)) if c)
        yield "BSD-3-Clause" if third else "BSD-2-Clause", "text", f"""Redistribution and use in source
and binary forms, with or without modification, are permitted provided that the following conditions
are met:
{listed}
THIS SOFTWARE IS PROVIDED BY THE {by} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE {liable} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""


def _long_texts():
    """Published texts with and without what follows the terms, as they are in use."""
    for name, text in TEXTS.items():
        forms = [text]
        if name == "Apache-2.0":
            # Where the line is filled in, it is a copyright line.
            forms.append(text.replace("Copyright [yyyy] [name of copyright owner]", ""))
        address = r"51 Franklin Street, Fifth Floor, Boston, MA +02110-1301 +USA"
        if re.search(address, text):
            forms.append(re.sub(address, "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", text))
            forms.append(re.sub(address, "<https://fsf.org/>", text, count=1))
        for form in forms:
            yield name, "text", form
            for end, kept in ((r"\n *END OF TERMS AND CONDITIONS", 1), (r"\nExhibit A - ", 0)):
                found = re.search(end, form)
                if found:
                    yield name, "text", form[:found.end() if kept else found.start()]
                    yield name, "text", form[:found.start()]


KNOWN += tuple(dict.fromkeys((
    *((n, k, f"{title}\n{rights}{t}") for n, k, t in _short_texts()
      for title, rights in product(_TITLES[n], _RIGHTS)), *_long_texts())))


def canonical(text: Column) -> Column:
    """Lower case (A to Z), copyright lines dropped, one spelling, words with single
    spaces between them; lines stay apart. A null text is empty."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    t = F.regexp_replace(t, _COPYRIGHT, "")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, _PUNCTUATION, " "))


def one_line(form: Column) -> Column:
    """A canonical form without its line breaks."""
    return F.trim(F.regexp_replace(form, r" *\n[ \n]*", " "))


def digest(line: Column) -> Column:
    """Digest of a canonical text; null where nothing is left."""
    return F.when(line != "", F.sha2(line, 256))


def known(spark: SparkSession, entries=KNOWN) -> DataFrame:
    """Digests of known licences: ``digest, licence``. One name for each digest."""
    rows = spark.createDataFrame([(n, t) for n, _, t in entries], "licence string, text string")
    form = one_line(canonical(F.col("text")))
    return (rows.select(digest(form).alias("digest"), "licence").filter("digest IS NOT NULL")
            .groupBy("digest").agg(F.min("licence").alias("licence")))


def scan(docs: DataFrame, licences: DataFrame, *, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """``doc_id, digest, n_chars, licence, notices`` for each row.

    ``licence`` is the known licence that the whole text is, else null; ``notices``
    lists those that a line is, sorted and joined by commas, else ''. Empty and null
    texts have a null digest. Repeated rows are reported as often. ``licences`` is
    ``digest, licence``; whether it is broadcast is left to its measured size.
    """
    forms = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("_form"))
    rows = forms.select(
        "doc_id", one_line(F.col("_form")).alias("_whole"),
        F.filter(F.transform(F.split("_form", "\n"), lambda s: F.trim(s)),
                 lambda s: s != "").alias("_lines"))
    # Kept, as both joins need it: a few digests for each text.
    rows = cut(rows.select("doc_id", digest(F.col("_whole")).alias("digest"),
                           F.length("_whole").cast("long").alias("n_chars"),
                           F.array_sort(F.array_distinct(F.transform(
                               "_lines", lambda s: F.sha2(s, 256)))).alias("_digests")))
    # Every line is looked up, as a notice may have any words; equal rows get equal answers.
    hits = (rows.filter(F.size("_digests") > 0)
            .select("doc_id", "digest", F.explode("_digests").alias("_line"))
            .join(licences.select(F.col("digest").alias("_line"),
                                  F.col("licence").alias("_notice")), "_line")
            .groupBy("doc_id", "digest")
            .agg(F.concat_ws(",", F.sort_array(F.collect_set("_notice"))).alias("notices")))
    whole = rows.drop("_digests").join(licences, "digest", "left").alias("w")
    h = hits.alias("h")
    return (whole.join(h, F.col("w.doc_id").eqNullSafe(F.col("h.doc_id"))
                       & F.col("w.digest").eqNullSafe(F.col("h.digest")), "left")
            .select("w.doc_id", "w.digest", "w.n_chars", "w.licence",
                    F.coalesce("h.notices", F.lit("")).alias("notices")))
