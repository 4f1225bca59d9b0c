"""Licence scans by canonical digests.

A text is brought to one form: small letters, no copyright lines, no punctuation, one spelling
for words that count as equal. Its SHA-256 is looked up among those of known licences and
notices by a join. Whole texts are looked up, and each line by itself for notices.

There are two forms. ``canonical`` is that of the ``digest`` column and of the SQL. Lookups use
``matching``, which also folds Unicode punctuation and widths, drops copyright lines that name
the holder first, and is taken of more texts: those of ``whole_texts``.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import product
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablemill.llm.common import small_batches, text_bytes

# Spellings that count as the word on the right.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "centre": "center",
    "colour": "color",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "honour": "honor",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "merchantibility": "merchantability",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "organisations": "organizations",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Known licences and notices, by SPDX identifier.
KNOWN = {
    "MIT": (
        """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ),
    "BSD-2-Clause": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
        "SPDX-License-Identifier: Zlib",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
}

#: Headings under which short licences stand, or none.
HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: One entire text per file, named by its identifier.
FOLDER = Path(__file__).with_name("known")
#: Lines at which a text without its heading starts, and at which one without its appendix ends.
_STARTS = re.compile(
    r"(?m)^[\x20\t]*(?:preamble|terms and conditions for use[^\n]*|1\. definitions\.?|statement of purpose"
    r"|this version of the gnu lesser[^\n]*|redistribution and use in[^\n]*)$",
    re.IGNORECASE,
)
_ENDS = re.compile(r"(?m)^[\x20\t]*(?:end of terms and conditions$|exhibit a\b)", re.IGNORECASE)
_NUMBERS = re.compile(r"(?m)^[\x20\t]*[0-9]\.[\x20\t]")

#: Lines that state a copyright; the same text serves Python and SQL.
COPYRIGHT = r"(?m)^[\x20\t*#/;.-]*(?:copyright[\x20\t:]+(?:\(c\)|©|[0-9<\[{])|\(c\)|©|all rights reserved)[^\n]*"
WORDS = r"[^a-z0-9\x80-\xff]+"

_COPYRIGHT = re.compile(COPYRIGHT.encode())
_BREAKS = re.compile(WORDS.encode("latin-1"))
_SPELLINGS = {k.encode(): v.encode() for k, v in SPELLINGS.items()}


def canonical(text: bytes | None) -> bytes:
    """The form in which texts that count as equal are equal; empty for NULL."""
    low = _COPYRIGHT.sub(b"", (text or b"").lower())
    words = _BREAKS.sub(b" ", low).split()
    return b" ".join([_SPELLINGS.get(w, w) for w in words])


def digest(text: bytes | None) -> str:
    return hashlib.sha256(canonical(text)).hexdigest()


#: Copyright lines as above, and those with a name first: they end in a year, what follows it and an address.
_STATED = re.compile(
    r"(?m)^(?:[^\w\n]|_)*(?:copyright[\x20\t:]+(?:\(c\)|©|[0-9<\[{])|\(c\)|©|all rights reserved"
    r"|copyright[\x20\t:]+(?!(?:and|disclaimer|holders?|in|interests?|is|laws?|licen[cs]es?|notices?|of|or|owners?|rights?|statements?|to|treaty)\b)"
    r"[^\n]*?\b(?:19|20)[0-9]{2}\b[^\n\w]*(?:present|now)?[^\n\w]*(?:<[^>\n]*>)?[^\n\w]*(?:all rights reserved)?[^\n\w]*$)[^\n]*"
)
_WORD = re.compile(r"[^\W_]+")
_EQUAL = SPELLINGS | {"https": "http"}


def _plain(text: bytes | None) -> str:
    """Small letters; letters and punctuation of special width or form as plain ones."""
    out = (text or b"").decode("utf-8", "replace")
    return (out if out.isascii() else unicodedata.normalize("NFKC", out)).lower()


def _matching(plain: str) -> str:
    words = [_EQUAL.get(w, w) for w in _WORD.findall(_STATED.sub("", plain))]
    return " ".join(words).replace("copyright owner", "copyright holder")


def matching(text: bytes | None) -> str:
    """The form in which a text equals a known one; empty for NULL."""
    return _matching(_plain(text))


def _first(plain: str) -> str:
    """The first word of ``_matching`` of a line, if that isn't empty."""
    word = _WORD.search(plain)
    return _EQUAL.get(word[0], word[0]).split(" ", 1)[0] if word else ""


def _key(form: str) -> str:
    return hashlib.sha256(form.encode()).hexdigest()


@cache
def whole_texts() -> dict[str, tuple[str, ...]]:
    """Entire licences with and without heading, appendix and numbers of short lists, by identifier."""
    short = {name: KNOWN[name][0] for name in HEADINGS if name in KNOWN}
    out: dict[str, list[str]] = {}
    for file in sorted(FOLDER.glob("*.txt")):
        text = file.read_text("utf-8")
        starts = {0, *(m.start() for m in _STARTS.finditer(text))}
        ends = {len(text), *(x for m in _ENDS.finditer(text) for x in m.span() if text[x : x + 1] in ("", "\n") or x == m.start())}
        out[file.stem] = [text[a:b] for a, b in product(sorted(starts), sorted(ends)) if b - a > len(text) // 2]
        if file.stem in HEADINGS:
            body = text[max(starts) :]
            holder = body.replace("the University", "the copyright holder").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT HOLDER OR")
            out[file.stem].append(body)
            short[file.stem] = holder
    for name, text in short.items():
        body = text.removeprefix(f"{HEADINGS[name][0]}\n")
        bodies = {body, _NUMBERS.sub("", body)} | {_NUMBERS.sub("", x) for x in out.get(name, ())}
        out.setdefault(name, []).extend(f"{h}\n\n{b}" for h, b in product(("", *HEADINGS[name]), sorted(bodies)))
    return {name: tuple(texts) for name, texts in out.items()}


def _forms(known: dict[str, tuple[str, ...]] | None) -> dict[str, str]:
    """Each known text in its matching form, with the first licence that has it; None is all that is known."""
    found: dict[str, str] = {}
    for part in (KNOWN, whole_texts()) if known is None else (known,):
        for licence, texts in part.items():
            for text in texts:
                found.setdefault(matching(text.encode()), licence)
    return found


def catalogue(spark: SparkSession, known: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(known_digest, licence): a digest for each known text, the first licence that has it."""
    return spark.createDataFrame([(_key(f), x) for f, x in _forms(known).items()], "known_digest string, licence string")


def licences(
    docs: DataFrame, known: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, digest, licence, notices) for every row of ``docs``.

    ``digest`` is that of the whole text's canonical form, ``licence`` the known licence it
    matches (NULL: none), ``notices`` the licences of the lines that match a known text, each
    once, in order, joined by commas. By default KNOWN and ``whole_texts`` are known. NULL and empty texts have the digest of nothing and are no licence. A NULL id is
    kept; rows of one id each get a row. An empty table gives an empty one. Extra columns are
    ignored.
    """
    # A text or line can only match a known text if it starts with that text's first word.
    openings = {f.split(" ", 1)[0] for f in _forms(known) if f}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(2):
                text = t.as_py() or b""
                plain = _plain(text)
                lines = plain.split("\n")
                opening = next((w for x in lines if (w := _first(x)) and not _STATED.match(x)), "")
                whole = _key(_matching(plain)) if opening in openings else ""
                out.append([digest(text), whole, *(_key(_matching(x)) for x in lines if _first(x) in openings)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["row", "id", "digests"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text_col).alias("t"))
    digests = rows.mapInArrow(run, "row long, id long, digests array<string>").select("row", "id", F.posexplode("digests").alias("k", "digest"))
    named = digests.join(catalogue(docs.sparkSession, known), F.col("digest") == F.col("known_digest"), "left")
    return named.groupBy("row").agg(
        F.max("id").alias("doc_id"),
        F.max(F.when(F.col("k") == 0, F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("k") == 1, F.col("licence"))).alias("licence"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("k") > 1, F.col("licence")))), ",").alias("notices"),
    ).drop("row")


def canonical_sql(text: str) -> str:
    """SQL for ``canonical`` of a text column."""
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({low}, '{COPYRIGHT}', '', 'g')"
    out = f"trim(regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"
    for a, b in SPELLINGS.items():
        out = f"regexp_replace({out}, '(^| ){a}\\b', '\\1{b}', 'g')"
    return out


def oracle_sql(known: dict[str, tuple[str, ...]] = KNOWN) -> str:
    """SQL that gives the rows of ``licences`` over documents, for ids that are not repeated.

    It knows the texts of KNOWN only, in their canonical form, not ``whole_texts``.
    """
    quoted = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, texts in known.items() for text in texts)
    return f"""
WITH given(licence, body) AS (VALUES {quoted}),
known AS (SELECT sha256({canonical_sql('body')}) AS known_digest, min(licence) AS licence FROM given GROUP BY 1),
whole AS (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
marked AS (SELECT DISTINCT doc_id, {canonical_sql('line')} AS form FROM lines),
noted AS (SELECT m.doc_id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices
          FROM marked m JOIN known k ON sha256(m.form) = k.known_digest GROUP BY m.doc_id)
SELECT w.doc_id, w.digest, k.licence, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.digest = k.known_digest LEFT JOIN noted n ON n.doc_id = w.doc_id
"""
