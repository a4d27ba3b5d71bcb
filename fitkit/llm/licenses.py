"""Licence recognition by sentences: known sentences get identifiers, rules match their order.

A text is cut into sentences; each is normalised and looked up in a table of known licence
sentences.  Where licences name their holder, the sentence is known with any name.  An SPDX line is
read as one sentence for each licence of its expression.  The identifiers of a document in reading
order are then matched against ordered rules: earlier rules are more specific and use up the
sentences they match.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCE_END = r"(?<=[.!?])[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"

# The wording of public licences, by identifier.
TEXTS = {
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MIT-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "ISC-liable": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-liable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "Apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Apache-copy": "You may obtain a copy of the License at",
    "Apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "GPL-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-see": "See the GNU General Public License for more details.",
    "LGPL-see": "See the GNU Lesser General Public License for more details.",
    "AGPL-see": "See the GNU Affero General Public License for more details.",
    "GPL3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
    "GPL2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "AGPL-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "MPL-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "Zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "OFL-terms": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "WTFPL-do": "You just DO WHAT THE FUCK YOU WANT TO.",
    "CC0-waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense-domain": "This is free and unencumbered software released into the public domain.",
}
# Licence names by identifier, for sentences that only refer to a licence.
NAMES = {
    "MIT": ("MIT License", "MIT Licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL 3.0"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache License 1.1"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License - v 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL v1.2"),
    "MS-PL": ("Microsoft Public License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "PostgreSQL": ("PostgreSQL License",),
    "Python-2.0": ("Python License 2.0",),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL 2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
LEADS = (
    "Licensed under",
    "Released under",
    "Distributed under",
    "Published under",
    "Available under",
    "This work is licensed under",
    "This software is licensed under",
    "This project is licensed under",
    "This file is licensed under",
    "This program is licensed under",
    "This software is released under",
    "This project is released under",
    "Distributed under the terms of",
    "SPDX-License-Identifier:",
)
#: Licences of which a reference may ask for this version only or for any later one, and how it says so.
VERSIONED = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
CHOICES = {
    "-only": (" only",),
    "-or-later": (" or later", " or any later version", " or, at your option, any later version", "+"),
}
#: Where licences name their holder: what stands around the name in a normalised sentence.
HOLDERS = (
    (r"^(neither the name of ).+( nor the names of its contributors )", "the copyright holder"),
    (r"^(this software is provided by ).+( as is and any express )", "the copyright holders and contributors"),
    (r"^(in no event shall ).+( be liable for any direct indirect )", "the copyright holder or contributors"),
    (r"^(in no event shall ).+( be liable for any claim damages )", "the authors or copyright holders"),
    (r"^(to the extent possible under law ).+( has waived all copyright )", "the author"),
)
SPDX = "SPDX-License-Identifier:"
#: Rules in order: a licence and the sentence identifiers that must follow one another, with
#: other known sentences allowed between them.
RULES = (
    ("BSD-4-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-advert", "BSD-endorse")),
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary")),
    ("MIT", ("MIT-grant", "MIT-notice", "MIT-asis")),
    ("MIT", ("MIT-grant", "MIT-notice")),
    ("Apache-2.0", ("Apache-grant", "Apache-copy")),
    ("Apache-2.0", ("Apache-grant",)),
    ("ISC", ("ISC-grant",)),
    ("0BSD", ("0BSD-grant",)),
    ("GPL-3.0-only", ("GPL3-only",)),
    ("GPL-2.0-only", ("GPL2-only",)),
    ("AGPL-3.0-or-later", ("AGPL-free",)),
    ("LGPL-3.0-or-later", ("LGPL3-free",)),
    ("Zlib", ("Zlib-asis", "Zlib-liable", "Zlib-grant")),
    ("BSL-1.0", ("BSL-grant",)),
    ("EPL-2.0", ("EPL2-terms",)),
    ("OFL-1.1", ("OFL-terms",)),
    ("WTFPL", ("WTFPL-do",)),
    ("CC0-1.0", ("CC0-waive",)),
    ("GPL-3.0-or-later", ("GPL-free",)),
    ("GPL-2.0-or-later", ("GPL2-free",)),
    ("LGPL-2.1-or-later", ("LGPL-free",)),
    ("MPL-2.0", ("MPL-terms",)),
    ("Unlicense", ("Unlicense-domain",)),
    *((name, (f"ref:{name}",)) for name in NAMES),
    *((name + choice, (f"ref:{name}{choice}",)) for name in VERSIONED for choice in CHOICES),
    ("fragment", ("MIT-grant",)),
    ("fragment", ("BSD-grant",)),
)


def normalised(sentence: Column) -> Column:
    """Lower case; runs of anything but letters, digits, dots within numbers become one space."""
    x = F.regexp_replace(F.lower(sentence), r"(?<![0-9])\.|\.(?![0-9])|[^a-z0-9.\x{80}-\x{10FFFF}]+", " ")
    return F.trim(F.regexp_replace(x, " {2,}", " "))


def with_any_holder(key: Column) -> Column:
    """A normalised sentence with the holder's name as the table has it."""
    for pattern, holder in HOLDERS:
        key = F.regexp_replace(key, pattern, f"$1{holder}$2")
    return key


def sentences() -> list[tuple[str, str]]:
    """``(identifier, text)`` of every known sentence, references to licences included."""
    rows = list(TEXTS.items())
    named = {name: (*forms, name) for name, forms in NAMES.items()}
    for name in VERSIONED:
        for choice, ends in CHOICES.items():
            named[name + choice] = (name + choice, *(form + end for form in named[name] for end in ends))
    for name, forms in named.items():
        for lead, the, form in product(LEADS, ("", "the ", "a ", "an "), forms):
            rows.append((f"ref:{name}", f"{lead} {the}{form}"))
    return rows


def sentence_table(spark: SparkSession) -> DataFrame:
    """``key, sentence_id`` of every known sentence; some thousand rows, whatever the corpus."""
    table = spark.createDataFrame(sentences(), "sentence_id string, text string")
    return (
        table.select(with_any_holder(normalised(F.col("text"))).alias("key"), "sentence_id")
        .groupBy("key")
        .agg(F.min("sentence_id").alias("sentence_id"))
    )


def beginnings() -> str:
    """A pattern for the first two words of the known sentences, whatever stands between them."""
    pairs = {tuple(re.findall("[a-z0-9]+", text.lower())[:2]) for _, text in sentences()}
    between = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"
    return f"(?i)^[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]*(?:{'|'.join(sorted(a + between + b for a, b in pairs))})"


def known_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, place, sentence_id``: every known sentence of every text.

    A sentence that spans lines is looked up whole and line by line, so that a licence line
    below a heading without a full stop is found as well as wrapped licence text.  An SPDX line gives
    one sentence for each word of its expression.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("t")
    )
    cut = rows.select("doc_id", "row", F.posexplode(F.split("t", SENTENCE_END)).alias("at", "s"))
    forms = F.when(
        F.contains("s", F.lit("\n")), F.concat(F.array("s"), F.split("s", "\n"))
    ).otherwise(F.array("s"))
    lines = cut.select("doc_id", "row", "at", F.posexplode(forms).alias("line", "s"))
    # Only sentences that begin like a known one need be normalised; comment signs may stand before.
    marked = F.regexp_extract("s", f"(?i){SPDX}[\\x20\\t]*([^\\r\\n]*)", 1)
    likely = lines.withColumn("spdx", marked).filter((F.col("spdx") != "") | F.col("s").rlike(beginnings()))
    named = F.transform(
        F.filter(F.split("spdx", "[^A-Za-z0-9.+-]+"), lambda x: x != ""), lambda x: F.concat(F.lit(f"{SPDX} "), x)
    )
    each = likely.select(
        "doc_id", "row", "at", "line", F.posexplode(F.when(F.col("spdx") != "", named).otherwise(F.array("s"))).alias("part", "s")
    )
    keyed = each.select(
        "doc_id", "row", F.struct("at", "line", "part").alias("place"), with_any_holder(normalised(F.col("s"))).alias("key")
    )
    known = sentence_table(docs.sparkSession)
    return keyed.join(F.broadcast(known), "key").select("doc_id", "row", "place", "sentence_id")


def match_rules(ids: list[str]) -> list[str]:
    """Licences of a sequence of sentence identifiers; each sentence serves one match."""
    left = list(ids)
    found = []
    for licence, wanted in RULES:
        while True:
            spots, at = [], 0
            for w in wanted:
                at = next((i for i in range(at, len(left)) if left[i] == w), -1)
                if at < 0:
                    break
                spots.append(at)
                at += 1
            if at < 0:
                break
            found.append((spots[0], licence))
            for i in spots:
                left[i] = None
    return [licence for _, licence in sorted(found)]


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentences, licences`` of every document with a known sentence.

    ``sentences`` are identifiers in reading order, ``licences`` those of the rules that match, in
    the order in which they begin.  Documents without a known sentence, null and empty texts give
    no row.  Rows that repeat an id and a text give one row; a null id stays null.
    """
    known = known_sentences(docs, id_col, text_col).distinct()
    grouped = known.groupBy("doc_id", "row").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "sentence_id"))), lambda x: x["sentence_id"]
        ).alias("sentences")
    )

    @F.pandas_udf("array<string>")
    def matched(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: match_rules(list(x)))

    return grouped.select("doc_id", "sentences", matched("sentences").alias("licences"))
