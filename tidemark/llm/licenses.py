"""Licence scan by canonical digests.  DataFrame and SQL functions only.

A text is brought to a canonical form: lower case, no copyright lines, no white
space and no ASCII punctuation, and one spelling for words that have several.  So
the form doesn't depend on where lines are wrapped or words hyphenated.  The
SHA-256 of the whole canonical text is looked up in a table of digests of known
licences.  Each line of a text is looked up in the same way, which finds one-line
notices inside longer texts.

Spellings change a length only where one of their words stands, so each known text
has a least and a most length before spellings are replaced.  Only texts and lines
of such a length get their spellings replaced and a digest; all others can't match.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Lines that name a holder or reserve rights; they vary between copies of one licence.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n(©]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4})[^\n]*|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4})[^\n]*|all rights reserved[^a-z0-9\n]*)$"
#: Notices that are part of a licence's own text and so must go wherever its lines are wrapped: the holder of the GNU licences,
#: and the models of a notice in what they say about their use.
OWN_NOTICE = r"copyright\s+\(c\)\s+(?:[0-9]{4}(?:[,\s]+[0-9]{4})*,?\s+free\s+software\b|(?:<year>|year|19yy)\s+<?(?:name\s+of\s+author|your\s+name)>?)"
#: ASCII other than letters, digits and the line feed, the blank that doesn't break, and typographic quotes and dashes.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{2010}-\x{2015}\x{2018}-\x{201F}]+"

#: Spelling -> the equivalent that stands for it, both without blanks, replaced in this order.
SPELLINGS = [
    ("licence", "license"),
    ("copyrightholder", "copyrightowner"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authoris", "authoriz"),
    ("behaviour", "behavior"),
    ("catalogue", "catalog"),
    ("cheque", "check"),
    ("colour", "color"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialis", "initializ"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("merchantibility", "merchantability"),
    ("optimis", "optimiz"),
    ("organis", "organiz"),
    ("practise", "practice"),
    ("programme", "program"),
    ("programme", "program"),  # again, as "program merely" without its blank holds the first
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = """.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
"""
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

#: Usual titles, and texts with or without them.
_TITLED = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)", "License: MIT", "MIT"], [_MIT_GRANT]),
    ("ISC", ["ISC License", "The ISC License", "ISC License (ISC)"], [_ISC_GRANT + _ISC_NOTICE + _ISC_END]),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"], [_ISC_GRANT + _ISC_END]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"], [_BSD_TWO + _BSD_END]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"], [_BSD_TWO + _BSD_THIRD + _BSD_END]),
    ("Zlib", ["zlib License", "The zlib License"], [_ZLIB]),
    ("Unlicense", ["The Unlicense", "Unlicense"], [_UNLICENSE + f"\nFor more information, please refer to <{u}>\n" for u in ("https://unlicense.org", "http://unlicense.org/")] + [_UNLICENSE]),
    ("BSL-1.0", [], [_BOOST]),
]
#: Fixed values: (identifier, text) of known licences and of the notices that name one in a line.
KNOWN = [(name, title + "\n\n" + text) for name, titles, texts in _TITLED for title in ("", *titles) for text in texts] + [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]

#: Fixed values: (identifier, least and most canonical length before spellings, digest) of the usual texts of long licences, with
#: and without the appendix that says how to apply them; from the copies that Debian ships in its folder of common licences.
KNOWN_DIGESTS: list[tuple[str, int, int, str]] = [
    ("Apache-2.0", 8314, 8322, "ebfb9839bd55fb97095d377ca4adb8514fee4dd44a98ccbe2a8b430b3fe605f5"),
    ("Apache-2.0", 7436, 7443, "9385e77162734bf297f30f924cb02e25e9b96adc73405f38cf55279760020177"),
    ("Artistic-1.0-Perl", 4841, 4864, "9b93f620b60b0e6baec35a532edc34a1260b73b1f0c1362f216d38c5b23f7d0d"),
    ("CC0-1.0", 5605, 5605, "a1c5451395262a9c57097cf8ed1be6259bce24f74691c20b350916c920658336"),
    ("GFDL-1.2-only", 16276, 16296, "53a25806a1adf39a10697d8cba54db9b9a206c0e81d3aeb7aed62c15a0d27229"),
    ("GFDL-1.2-only", 15283, 15299, "701b1ba5304b891aedd7bee0da15c36868cd46101343c6cc1e9ddb9d39f16baa"),
    ("GFDL-1.3-only", 18289, 18317, "61f3e436425a5c90ffed718d8678bd89fd05e75460178442ecd712b58550b0c8"),
    ("GFDL-1.3-only", 17296, 17320, "eac1400419b7581dd0d943a55a2b5a724b35d6b913a4f7fac3b3b01cb0b6a6eb"),
    ("GPL-1.0-only", 9705, 9924, "938c401318602f06ae446b6dfdbcc97b575b8547f3d2003f19089e163d83ffe9"),
    ("GPL-1.0-only", 7783, 7950, "c9fe98f1511d8d5b2ebc101ab6592b4ba723b2bd458aea374692aaf0ed18867c"),
    ("GPL-2.0-only", 14122, 14439, "fccf619458ea36143b5e13479ebcf97c4c2b2510c45db33fa9396186c6070051"),
    ("GPL-2.0-only", 11987, 12244, "a2e7d254f9f33b814e3bb2224806f41fb9c0871802692f11beed7dc835935871"),
    ("GPL-3.0-only", 27711, 27971, "890a5feecef90840abfaebcd0a9a322c51220439638505b1cf143479362ab67d"),
    ("GPL-3.0-only", 25741, 25937, "0f4006ffa8cc6674c78695150f682e166b09b3515f0bd214f52094ad442876de"),
    ("LGPL-2.0-only", 19938, 20039, "431d685ab679c899e24193af8f52c6a08d0e1c4583d02c1a8a29809002e2bb41"),
    ("LGPL-2.0-only", 18422, 18519, "f27f80f9b273a3dd95c134e8251673790de6e17d067cf73a7108a1067feac1e6"),
    ("LGPL-2.1-only", 20824, 20917, "f54ffc8a961bc8a8e737929205b0668b96b3a015dc819d852d5314386a2f9c03"),
    ("LGPL-2.1-only", 19310, 19399, "8d3788465d7cece52336475be061f47b140daa97d73bb11f7e79bf2e67b44568"),
    ("LGPL-3.0-only", 5898, 5902, "33871f6ada7e0137f47f08ebfe3973739a37c2c75e0f99c079cb11aad0e85dbf"),
    ("MPL-1.1", 18663, 18668, "174cdaddb0510b80ef88f5908a0e4bf75f251039c264571a1826a5f595be18c0"),
    ("MPL-2.0", 11916, 11918, "b203b68ce18fc8813145291e137d23b974d9d04de13b0366be0bb4431a2d1cb1"),
]

#: Known digests up to which they are broadcast; beyond, they are joined by digest.
BROADCAST_KNOWN = 100_000

_MARKS = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), PUNCTUATION))


def known_entry(name: str, text: str) -> tuple[str, int, int, str]:
    """(identifier, least length, most length, digest) of a licence's text."""
    canonical = _MARKS.sub("", re.sub(COPYRIGHT_LINE, "", re.sub(OWN_NOTICE, "", text.lower()))).replace("\n", "")
    for spelling, stands in SPELLINGS:
        canonical = canonical.replace(spelling, stands)
    change = [canonical.count(stands) * (len(spelling) - len(stands)) for spelling, stands in SPELLINGS]
    least, most = (len(canonical) + sum(x for x in change if (x > 0) == longer) for longer in (False, True))
    return name, least, most, sha256(canonical.encode()).hexdigest()


def known_entries(known: list[tuple[str, str]] | None = None) -> list[tuple[str, int, int, str]]:
    """Entries of the given texts, or of all that this module knows; two licences with one digest: the smaller identifier."""
    entries = [known_entry(*x) for x in KNOWN] + KNOWN_DIGESTS if known is None else [known_entry(*x) for x in known]
    byhash = {e[3]: e for e in sorted(entries, reverse=True)}
    return [e for e in byhash.values() if e[2] > 0]


def _plain(text: Column) -> Column:
    """The canonical form but for spellings, with line feeds."""
    low = F.lower(text)
    marked = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("all rights"))
    return F.regexp_replace(F.when(marked, F.regexp_replace(F.regexp_replace(low, OWN_NOTICE, ""), COPYRIGHT_LINE, "")).otherwise(low), PUNCTUATION, "")


def _digest(plain: Column) -> Column:
    for spelling, stands in SPELLINGS:
        plain = F.replace(plain, F.lit(spelling), F.lit(stands))
    return F.sha2(plain, 256)


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, license, notices, n_notice_lines of every row of ``docs``.

    ``license`` is the licence that the whole text is, null if none; ``notices``
    the licences that the lines of a text of several lines name, sorted, comma
    separated, empty if none.  Null, empty and all-punctuation texts match nothing.
    Each row is judged by its own text: rows that share an id, or have none, don't
    share what is found.  ``known`` (identifier, text) replaces the known licences.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "licenses")
    entries = known_entries(known)
    lengths = sorted({n for e in entries for n in range(e[1], e[2] + 1)})
    plain = docs.select("doc_id", "text", _plain(F.col("text")).alias("plain"))
    lines = F.filter(F.split("plain", "\n"), lambda x: x != "")
    plain = plain.select("doc_id", "text", F.replace("plain", F.lit("\n"), F.lit("")).alias("whole"), lines.alias("lines"))
    single = F.filter(F.when(F.size("lines") > 1, F.col("lines")).otherwise(F.array().cast("array<string>")), lambda x: F.length(x).isin(lengths))
    plain = plain.select("doc_id", "text", F.when(F.length("whole").isin(lengths), F.array("whole")).otherwise(F.array().cast("array<string>")).alias("whole"), single.alias("lines"))
    unit = lambda whole: lambda x: F.struct(F.lit(whole).alias("whole"), _digest(x).alias("digest"))
    some = F.size("whole") + F.size("lines") > 0
    # A row without a unit that can match has no key; what is found depends on the text alone.
    rows = plain.select("doc_id", F.when(some, F.sha2("text", 256)).alias("key"), F.when(some, F.concat(F.transform("whole", unit(True)), F.transform("lines", unit(False)))).alias("units"))
    rows = scratch.keep(rows, "units")
    if not entries:
        found = rows.select("key", F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("notices"), F.lit(0).cast("long").alias("n")).limit(0)
    else:
        table = spark.sql("select * from values " + ", ".join(f"('{d}', '{name.replace(chr(39), chr(39) * 2)}')" for name, _, _, d in entries) + " as known(digest, name)")
        table = F.broadcast(table) if len(entries) <= BROADCAST_KNOWN else table
        units = rows.where("key is not null").groupBy("key").agg(F.first("units").alias("units")).select("key", F.explode("units").alias("u"))
        hits = units.select("key", "u.whole", "u.digest").join(table, "digest")
        found = hits.groupBy("key").agg(
            F.min(F.when(F.col("whole"), F.col("name"))).alias("license"),
            F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("name")))), ",").alias("notices"),
            F.count(F.when(~F.col("whole"), 1)).alias("n"),
        )
    out = rows.where("key is not null").select("doc_id", "key").join(found, "key", "left").select("doc_id", "license", "notices", "n")
    out = out.unionAll(rows.where("key is null").select("doc_id", F.lit(None).cast("string"), F.lit(""), F.lit(0).cast("long")))
    return out.select("doc_id", "license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notice_lines"))
