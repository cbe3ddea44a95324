"""
License scans by canonical digests.

A text is brought to canonical form: A-Z in lower case, every run of other ASCII characters than letters, digits and line
feeds one space, equivalent spellings one spelling, lines that are copyright notices empty. Entire texts, and entire
lines as texts of their own, are then hash-joined by digest to the digests of known licences: licence texts and the
one-line notices that name a licence. The table of known digests is fixed and small, so it is broadcast; documents are
neither shuffled nor joined with each other, one narrow row a document is.

Defined cases: null and empty texts have the digest of the empty text and no licence; a text that names a licence inside a longer
line is no match; repeated rows and null ids are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as one (the SPDX matching guidelines list such pairs).
SPELLINGS = [
    ("licence", "license"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("fulfilment", "fulfillment"),
    ("whilst", "while"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non derivative", "noderivative"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
]

# Names by which notices call a licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0", "CC0 1.0 Universal"],
}
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NOTICES = ["{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}", "Available under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This project is licensed under the {}", "This file is licensed under the {}", "Licensed under the terms of the {}", "License: {}", "SPDX-License-Identifier: {}"]

# Licence texts.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEXTS = {
    "MIT": [_MIT],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS],
    "BSD-2-Clause": [_BSD_HEAD + "\n" + _BSD_TAIL],
    "BSD-3-Clause": [_BSD_HEAD + "\n" + _BSD_NAME + "\n" + _BSD_TAIL],
}

# Usual headings of these texts; each may also be followed by a line "All rights reserved.".
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "BSD License", "The BSD License"],
}
TEXTS = {k: [f"{h}\n{r}\n{t}" if h or r else t for t in v for h in ("", *HEADINGS[k]) for r in ("", "All rights reserved.")] for k, v in TEXTS.items()}

# digest_of long licence texts, whole and up to the end of their terms.
DIGESTS = {
    "Apache-2.0": ["2f973fce6821968caa77d834b80cee7c", "a90697331248535821cbca3716b02146", "d03e86ac7a1ff3f8d928e1d6027bfd17"],
    "MPL-2.0": ["7d4b8b0889da3c01eff3fe431102e6d6"],
    "GPL-2.0": ["5e39ace6e62f5a7fe9c17b4da986ad8c", "68380dbeadb093b94ecf563db7312db7", "f2c06efe640b4a281cbe5337cdde80ab"],
    "GPL-3.0": ["17e434cc6db7003444b088cb4cc81e91", "444f95dc767ede978b60cfb20fbd0bca", "5eaa767cc0a56c87c3852144458a3bf1"],
    "LGPL-2.1": ["3054b3781b1af43f906dc753acad15ee", "eaf6afb73fc860a002bfbccbe6f07ce7", "f998bc436710cfece156aaa84fd26dd4"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "CC0-1.0": ["93a180096f6cfcf2c0dd24f75c2eec48"],
    "Unlicense": ["0ddb544fc94f1ac376b1b27618cf995a"],
    "CC-BY-SA-4.0": ["91ba7f2b9f9292fa546a3e86152e8c97"],
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OTHER = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
COPYRIGHT = r"^ ?(copyright|c|©) ?(c|©|[0-9]{4}|by)( [^\n]*)?$|^ ?copyright the( [^ \n]+){1,6} (authors|contributors|developers) ?$"


def _lines(text: str) -> str:
    """The canonical form with its line feeds, in Python: makes the known digests."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    text = re.sub("[^a-z0-9\n\x80-\U0010ffff]+", " ", text)
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return re.sub(COPYRIGHT, "", text, flags=re.M)


def digest_of(text: str) -> str:
    return hashlib.md5(re.sub("[ \n]+", " ", _lines(text)).strip(" ").encode()).hexdigest()


def known() -> dict[str, str]:
    """Digest → licence, for texts and notices."""
    names = {k: list(v) for k, v in NAMES.items()}
    for code, long in CREATIVE_COMMONS.items():
        for version in ("3.0", "4.0"):
            names[f"CC-{code}-{version}"] = [f"CC {code} {version}", f"CC-{code}-{version}", f"Creative Commons {long} {version} International License", f"Creative Commons {long} {version} License", f"Creative Commons {long} {version}"]
    out = {digest_of(n.format(name)): k for k, v in names.items() for name in [k, *v] for n in NOTICES}
    out[digest_of("All rights reserved.")] = "all-rights-reserved"
    out |= {d: k for k, v in DIGESTS.items() for d in v}
    return out | {digest_of(t): k for k, v in TEXTS.items() for t in v}


def canonical(text: Column) -> Column:
    """The canonical form with its line feeds."""
    x = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), OTHER, " ")
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, "(?md)" + COPYRIGHT, "")


def _known(spark: SparkSession, digest: str, license: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(sorted(known().items()), f"{digest} string, {license} string"))


def scan(docs: DataFrame) -> DataFrame:
    """
    doc_id, digest (of the entire text), license (that the entire text is, or null), notices (licences that entire lines
    are or name, sorted, comma between; null if none) and n_notices (such lines) for every row of docs (doc_id, text).
    """
    spark = docs.sparkSession
    x = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), canonical(F.col("text")).alias("x"))
    x = x.select("uid", "doc_id", F.md5(F.trim(F.regexp_replace("x", "[ \n]+", " "))).alias("digest"), F.split("x", "\n").alias("lines"))
    x = x.join(_known(spark, "digest", "license"), "digest", "left")
    lines = x.select("uid", "doc_id", "digest", "license", F.explode("lines").alias("line"))
    lines = lines.withColumn("line", F.md5(F.trim("line"))).join(_known(spark, "line", "notice"), "line", "left")
    # A document's lines follow each other in one task, so the map-side part leaves one row a document to shuffle.
    out = lines.groupBy("uid", "doc_id", "digest", "license").agg(F.array_sort(F.collect_set("notice")).alias("found"), F.count("notice").alias("n_notices"))
    return out.select("doc_id", "digest", "license", F.when(F.size("found") > 0, F.array_join("found", ",")).alias("notices"), "n_notices")


def oracle_sql() -> str:
    """DuckDB SQL with the rows of scan(documents)."""
    x = f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{OTHER}', ' ', 'g')"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    pairs = ", ".join(f"('{d}', '{k}')" for d, k in sorted(known().items()))
    return f"""
        WITH known(digest, license) AS (VALUES {pairs}),
        x AS (SELECT row_number() OVER () AS uid, doc_id, regexp_replace({x}, '(?m){COPYRIGHT}', '', 'g') AS x FROM documents),
        l AS (SELECT uid, md5(trim(unnest(string_split(x, chr(10))), ' ')) AS line FROM x),
        n AS (SELECT uid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices FROM l JOIN known ON line = digest GROUP BY uid)
        SELECT doc_id, md5(trim(regexp_replace(x, '[ \\n]+', ' ', 'g'), ' ')) AS digest, license, notices, coalesce(n_notices, 0) AS n_notices
        FROM x LEFT JOIN n USING (uid) LEFT JOIN known ON known.digest = md5(trim(regexp_replace(x, '[ \\n]+', ' ', 'g'), ' '))
    """
