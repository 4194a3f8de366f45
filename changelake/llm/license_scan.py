"""License scans by canonical digest lookup.

A text becomes canonical line by line: lower case, punctuation and white space
as one space, equivalent spellings as one, and copyright lines left out.  The
SHA-256 of the whole canonical text is hash-joined to the digests of known
license texts.  What matches none is looked up again by its core, which leaves
out the lines before a license's first words: titles, copyright lines of any
form, versions, addresses and links.  The same lookup is made for each canonical line against known
one-line license notices, as most texts carry no more than such a line.

The known texts are those of ``TEXTS``, ``MORE`` and ``CORES``; ``scan`` takes
further ones.  They are a few hundred rows, so broadcasting them is safe; there
is no shuffle, and everything is built from DataFrame functions.

Edge cases: null text is empty; an empty text has the digest of an empty string
and no license; repeated rows and ties change nothing; an empty table stays
empty; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# License texts and notices as published, copyright lines left out.
TEXTS = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
}
_BSD = TEXTS["BSD-2-Clause"].split("\n")
_NAMES = ("the copyright holder nor the names of its contributors", "copyright holder nor the names of contributors", "the author nor the names of its contributors", "the <organization> nor the names of its contributors", "the University nor the names of its contributors", "the authors nor the names of its contributors")
_BSD3 = ["\n".join([*_BSD[:3], f"3. Neither the name of {n} may be used to endorse or promote products derived from this software without specific prior written permission.", _BSD[3]]) for n in _NAMES]
_bullets = lambda t: re.sub(r"(?m)^[0-9]\. ", "* ", t)
#: Further texts, known by their core only.
MORE = [
    *[("BSD-2-Clause", _bullets(TEXTS["BSD-2-Clause"])), ("Zlib", _bullets(TEXTS["Zlib"])), ("ISC", TEXTS["ISC"].replace("and/or distribute", "and distribute"))],
    *[("BSD-3-Clause", t) for text in _BSD3 for t in (text, _bullets(text))],
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
]
MORE += [("Unlicense", MORE[-1][1].replace("https://unlicense.org", u)) for u in ("http://unlicense.org/", "https://unlicense.org/")]
# Core digests of long texts as published, with and without what follows their terms.
CORES: dict[str, list[str]] = {
    "Apache-2.0": [
        "deb545743ba2ee484c58a92230d43f8b6a39185ee86d9256ffdfefdb82b1dc6d",
        "fc9db7a0164e7200da89e02c3227560cc6bf5b50226261135c541f76ac8098f9",
        "dd6b373e28950376ea177a601b11ba7f0238e579d5802f43e69921c313c82549",
        "97bb151359ca7824a239b0d881e1a58ad4d423d5b5c39e5c7b235fd47c1d52f7",
        "870d08bb907524ee619c856cbdfa6b2d0ad90e2285ad618ef30c15600eb699cf",
    ],
    "CC-BY-4.0": [
        "7390754462340f4eb6baeb4611b7ec5bb868951313b539fe4a484318e7b79c51",
        "d820391ac3f3aa0f58a331b7d2b5bdd9f594d1324e369509db066eec0988c565",
        "025ca9e97f6b983aeabf1a018dc2318c550ab6b57a5716e0029e38f00236d65c",
    ],
    "CC0-1.0": [
        "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e",
    ],
    "GPL-1.0": [
        "ee41c15ce7d9cf5f29010590a0e4f4a6412fc1af33c10f280017db3f1fa0921b",
        "526a998a5f0ae9ed2e8c2dc03c12942fc9d724df13b0787dd3c80881d3688444",
        "8f3791039a137dc41a4222725079093e91fe98d5b92a8a4c0619e88addd253c6",
    ],
    "GPL-2.0": [
        "8bce3c0010045bb9ea13c8025ec3c58d82fddf2d6f2f7a01d807e27da9edc024",
        "1d3015d0c95ac4c468939c7dc58e73a3f73a8592aa68d2af118ce60740773df7",
        "95aeb819f45bf6639f460cc0ba5fa250f81764324ef35320bf76fb9f99428fc1",
        "97d5465462f2eceba0aa8f8ce38d8f9e7987e238f6fadb61dbe4f34b3a49029c",
        "37d5ffb67b9a128c3369e6bf2bb7b990ff212dcd086585e0319ff7ce55988d1f",
    ],
    "GPL-3.0": [
        "04a10e711844fe517f9ffba9481db6a825f2f268002c49184ecb8c942911bff3",
        "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19",
        "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2",
    ],
    "LGPL-2.0": [
        "61cbce1ad10d3b01d130a67aa9d339b8e0f260e773fe0383e51c1d9022ce9ede",
        "73dbe68688642ea8753271a313d85ca880b4dc28379e1b21b2615f96758c5210",
        "936eb024285b788f0eddbf96826d70da1adefa3099b0ec5336ffe495c00b7798",
    ],
    "LGPL-2.1": [
        "48e731def9111ee21e7b6b5dca5cb8e908fe999f7c1ef9175afef1e4c8a5e26a",
        "7cc1b31b95dd0bec1ff475bffceda6889681862c0b7d0da58cf97d3ae0a5d4bf",
        "f0b3313d45a8a467f987a040dc16addaea95621fdaededc28db994fccd572d0e",
        "a410900e6983c792f42e2267911d7570e409cfb8af0c9125ef02a022229ab14d",
    ],
    "LGPL-3.0": [
        "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",
    ],
    "MPL-1.1": [
        "34386b9a926117ec1b973ef1b1ef8fba50be254811addc9f9659bcc5d5a096bf",
    ],
    "MPL-2.0": [
        "61525901247b1a7c093fc10f73de8260d1d1a1a8b3bc78f417119ee4fcfb0979",
        "82f9523850a13d17b6806552d57c2fdcfa4799b49e70da7ae28736cd52fa3114",
        "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3",
    ],
}
# Equivalent spellings, on canonical text.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("organisation", "organization"), ("favour", "favor"))
CORE_SPELLINGS = (*SPELLINGS, ("https ", "http "))
PUNCTUATION = r"[^\p{L}\p{N}]+"
COPYRIGHT = r"^(copyright( c)? [0-9]{4}.*|c [0-9]{4}.*|copyright c .*|all rights reserved)$"

# Lines that may stand before a license's first words, on canonical text.
HEAD = r"^(copyright.*|portions copyright.*|c [0-9]{4}.*|all rights reserved.*|(the )?([a-z0-9]+ ){0,7}license( [a-z0-9]+){0,6}|version [0-9][a-z0-9 ]*|https? .*|creative commons legal code|cc0 1 0 universal|(creative commons )?attribution [a-z0-9 ]*international( public license)?|[0-9]+ (franklin|temple|mass) .*|(boston|cambridge) ma .*)$"


def canonical(line: Column) -> Column:
    """A line in canonical form; empty for a copyright line."""
    out = F.trim(F.regexp_replace(F.lower(line), PUNCTUATION, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, COPYRIGHT, "")


def canonical_text(text: str) -> list[str]:
    """The same, for the known texts."""
    out = []
    for line in text.split("\n"):
        line = re.sub(r"[\W_]+", " ", line.lower()).strip()
        for a, b in SPELLINGS:
            line = line.replace(a, b)
        if line and not re.match(COPYRIGHT, line):
            out.append(line)
    return out


def digest(text: str) -> str:
    return hashlib.sha256(" ".join(canonical_text(text)).encode()).hexdigest()


def core(text: str) -> str:
    """The digest of a text without the lines before its first words."""
    lines = canonical_text(text)
    while lines and re.match(HEAD, lines[0]):
        del lines[0]
    words = " ".join(lines)
    for a, b in CORE_SPELLINGS:  # again, as a spelling may stand over the end of a line
        words = words.replace(a, b)
    return hashlib.sha256(words.encode()).hexdigest()


def known_cores(more: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """Core digest and identifier of every known text, those of ``more`` first; texts without words are none."""
    out = {d: k for k, all_of in CORES.items() for d in all_of} | {core(t): k for k, t in [*TEXTS.items(), *MORE, *more]}
    out.pop(core(""), None)
    return sorted(out.items())


def known_digests() -> list[tuple[str, str]]:
    """Digest and identifier of every known text and notice."""
    return sorted({(digest(t), k) for k, t in TEXTS.items()} | {(digest(n), k) for k, names in NOTICES.items() for n in names})


def scan(docs: DataFrame, text: str = "text", keep: list[str] = ("doc_id",), more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """``keep`` with digest, license_id (of the whole text, null if unknown) and notices (of its lines).

    ``more`` holds further license texts: pairs of identifier and text.
    """
    known = docs.sparkSession.createDataFrame(known_digests(), "digest string, license_id string")
    table = F.create_map(*[F.lit(x) for pair in known_digests() for x in pair])
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), canonical), lambda x: x != "")
    rows = docs.select(*keep, lines.alias("lines"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: F.try_element_at(table, F.sha2(x, 256))), lambda x: x.isNotNull())))
    first = F.array_position(F.transform("lines", lambda x: x.rlike(HEAD)), F.lit(False)).cast("int")
    words = F.array_join(F.when(first > 0, F.slice("lines", F.greatest(first, F.lit(1)), F.size("lines"))).otherwise(F.array().cast("array<string>")), " ")
    for a, b in CORE_SPELLINGS:
        words = F.replace(words, F.lit(a), F.lit(b))
    rows = rows.select(*keep, F.sha2(F.array_join("lines", " "), 256).alias("digest"), F.sha2(words, 256).alias("__core"), F.array_join(found, ",").alias("notices"))
    cores = docs.sparkSession.createDataFrame(known_cores(more), "__core string, __core_id string")
    # The known tables are a few hundred rows.
    out = rows.join(F.broadcast(known), "digest", "left").join(F.broadcast(cores), "__core", "left")
    return out.select(*keep, "digest", F.coalesce("license_id", "__core_id").alias("license_id"), "notices")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    canon = r"trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        canon = f"replace({canon}, '{a}', '{b}')"
    canon = f"regexp_replace({canon}, '{COPYRIGHT}', '')"
    values = ", ".join(f"('{d}', '{k}')" for d, k in known_digests())
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
canon AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {canon}), lambda x: x <> '') AS lines FROM documents),
rows AS (SELECT doc_id, sha256(array_to_string(lines, ' ')) AS digest, lines FROM canon),
hits AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM
  (SELECT DISTINCT doc_id, license_id FROM (SELECT doc_id, sha256(unnest(lines)) AS digest FROM rows) JOIN known USING (digest)) GROUP BY doc_id)
SELECT r.doc_id, r.digest, k.license_id, coalesce(h.notices, '') AS notices
FROM rows r LEFT JOIN known k ON r.digest = k.digest LEFT JOIN hits h ON r.doc_id = h.doc_id
"""


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLES = {"op8_license_scan": _oracle()}
