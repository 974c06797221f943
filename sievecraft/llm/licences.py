"""Licence scan by canonical digest: whole texts against known licences.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space), hashed, and joined to
the digests of known licence texts. Names and years of holders don't matter, wording does, line breaks don't: a
copyright statement is left out twice, once by line and once by paragraph, as it may be wrapped over several lines or be
followed by the licence at once. It is one only with a sign or a year, so a wrapped line that begins with "copyright
notice" stays. The digest by lines is looked up first, then that by paragraphs.

Nulls: a null or empty text, or one that only holds copyright lines, is no licence and has a null digest. Repeated
rows are looked up one by one, whatever their number, and texts of any length are whole. Columns other than id and text
are ignored. An empty table gives an empty result; an empty licence list matches nothing.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Full texts of public licences, as their stewards publish them, and spellings that count as equal.
LICENCES = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) <year>, <copyright holders>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "Zlib": """zlib License

Copyright (c) <year> <copyright holders>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
}
_DUTY = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
LICENCES["BSD-3-Clause"] = LICENCES["BSD-2-Clause"].replace("BSD 2-Clause", "BSD 3-Clause").replace("\n\nTHIS SOFTWARE IS PROVIDED", f"\n\n3. {_DUTY}\n\nTHIS SOFTWARE IS PROVIDED")
#: Long licences are files, as their stewards publish them.
LICENCES |= {p.stem: p.read_text(encoding="utf-8").strip() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "authorise": "authorize",
    "authorised": "authorized",
    "organisation": "organization",
    "recognise": "recognize",
    "favour": "favor",
    "favourable": "favorable",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "merchantibility": "merchantability",
    "noncommercial": "non commercial",
    "noninfringement": "non infringement",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "per cent": "percent",
    "sub license": "sublicense",
    "while": "whilst",
}

#: How a copyright statement begins: with a sign, a year or a placeholder; and where a paragraph ends.
STATEMENT = r"(copyright[ \t]*(\(c\)|©)|copyright[ \t:]+(19|20|<|\[)|©|\(c\)[ \t]*(copyright[ \t]*)?(19|20|<|\[))"
OPENS = rf"^[\s/*#;-]*({STATEMENT}|all rights reserved)"
GAP = r"\n[ \t\r]*\n"
#: Normalising steps, in order; the patterns mean the same to Java, Python and RE2.
STEPS = (
    (rf"(?m)^[ \t/*#;-]*{STATEMENT}[^\n]*$", " "),
    (r"(?m)^[ \t/*#;-]*all rights reserved\.?[ \t\r]*$", " "),
    (r"\(c\)|©", " copyright "),
    (r"https?://", " "),
    (r"[^a-z0-9]+", " "),
    *((rf"\b{a}\b", b) for a, b in SPELLINGS.items()),
)


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_statements(text: Column) -> Column:
    """Lower-cased text without the paragraphs that are copyright statements; null for a text that has none."""
    some = lower(text).rlike(f"(?m){OPENS}")
    return F.when(some, F.array_join(F.filter(F.split(lower(text), GAP), lambda p: ~p.rlike(OPENS)), "\n"))


def normalise(text: Column, first: int = 0) -> Column:
    """Digits, a-z and single spaces, by the steps from ``first`` on: the first two leave out statements by line."""
    out = lower(text)
    for pattern, to in STEPS[first:5]:
        out = F.regexp_replace(out, pattern, to)
    # One pass finds all spellings; few texts hold any, so the others skip the replacements.
    spelled = out
    for pattern, to in STEPS[5:]:
        spelled = F.regexp_replace(spelled, pattern, to)
    any_spelling = r"\b(" + "|".join(SPELLINGS) + r")\b"
    return F.trim(F.when(out.rlike(any_spelling), spelled).otherwise(out))


def normalise_text(text: str, first: int = 0) -> str:
    """The same in Python, for the known licences and for tests."""
    out = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for pattern, to in STEPS[first:]:
        out = re.sub(pattern, to, out)
    return out.strip(" ")


def digests(licences: dict[str, str]) -> dict[str, str]:
    """Digest -> licence id, of the text with and without its title line."""
    out = {}
    for name, text in licences.items():
        first, _, rest = text.partition("\n")
        for form in [text, rest] if rest and len(first) < 40 else [text]:
            for norm in (normalise_text(form), normalise_text(bare_text(form), 2)):
                if norm:
                    out.setdefault(hashlib.sha256(norm.encode()).hexdigest(), name)
    return out


def bare_text(text: str) -> str:
    """Lower-cased text without the paragraphs that are copyright statements."""
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return "\n".join(p for p in re.split(GAP, low) if not re.search(OPENS, p))


def scan_licences(docs: DataFrame, licences: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, digest, licence (null if unknown). The list of known digests is a fixed, small table."""
    spark = docs.sparkSession
    known = spark.createDataFrame(list(digests(LICENCES if licences is None else licences).items()), "digest string, licence string")
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    own = own.select("id", normalise(F.col("text")).alias("lines"), normalise(without_statements(F.col("text")), 2).alias("parts"))
    hashed = lambda c: F.when(F.col(c) != "", F.sha2(F.col(c), 256)).alias(c)
    own = own.select("id", hashed("lines"), hashed("parts"))
    known, other = known.withColumnRenamed("digest", "lines"), known.select(F.col("digest").alias("parts"), F.col("licence").alias("by_parts"))
    found = own.join(F.broadcast(known), "lines", "left").join(F.broadcast(other), "parts", "left")
    by_parts = F.col("licence").isNull() & F.col("by_parts").isNotNull()
    return found.select(F.col("id").alias(id_col), F.when(by_parts, F.col("parts")).otherwise(F.col("lines")).alias("digest"), F.coalesce("licence", "by_parts").alias("licence"))
