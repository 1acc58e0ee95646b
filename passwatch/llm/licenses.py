"""License scan by sentence rules, with DataFrame functions only.

A text is normalised (lower case, comment marks and list marks at line starts, quotes, commas and brackets dropped, blanks collapsed) and
cut into sentences at line ends and sentence ends. Every sentence gets an identifier: a known one its own, an SPDX line one for each
licence that it names, any other the placeholder `?`. The identifiers, in the order of the text, are then read by ordered rules: a rule
names the sequence of identifiers that makes up a licence, which of them may be missing, and how many unknown sentences may stand between
two of them; what it matches is replaced by the licence's name, so that longer licences win over their parts. A known sentence may be
wrapped over several lines; each line of an unknown one counts as a sentence. Known identifiers that no rule takes are returned as
unmatched.

Edge cases: a null or empty text has no sentences, no licences and no unmatched ones (empty strings and 0); repeated sentences count each
time, a licence is named once for each text; texts are read whole; rows keep their other columns, and output columns of the same name
are replaced.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names, the phrases that refer to a licence, sentences of licence texts, and the rules in their order.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License", "MIT licence"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2.0", "GPL version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3.0", "GPL version 3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
PHRASES = [
    "Licensed under {}",
    "Licensed under the {}",
    "Licensed under the terms of the {}",
    "Released under the {}",
    "Released under {}",
    "Distributed under the {}",
    "Distributed under the terms of the {}",
    "Available under the {}",
    "It is licensed under the {}",
    "This library is licensed under the {}",
    "This package is licensed under the {}",
    "This software is licensed under the {}",
    "This work is licensed under {}",
    "This work is licensed under the {}",
    "This work is licensed under a {}",
    "This project is licensed under the {}",
    "This software is released under the {}",
    "This file is licensed under the {}",
]
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "isc-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-author": "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-urls": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-more": "See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-see": "If not, see <https://www.gnu.org/licenses/>.",
    "gpl-see-http": "If not, see <http://www.gnu.org/licenses/>.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-more": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-more": "See the GNU Affero General Public License for more details.",
    "agpl-copy": "You should have received a copy of the GNU Affero General Public License along with this program.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Licence, unknown sentences allowed between two parts, parts in order; one ending in "?" may be missing.
RULES = [
    ("MIT", 1, ["mit-grant", "mit-notice", "mit-warranty?", "mit-liability?"]),
    ("ISC", 1, ["isc-grant", "isc-warranty?", "mit-warranty?", "isc-liability?"]),
    ("BSD-3-Clause", 1, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty?", "bsd-liability?"]),
    ("BSD-3-Clause", 1, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names-author", "bsd-warranty?", "bsd-liability?"]),
    ("BSD-2-Clause", 0, ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty?", "bsd-liability?"]),
    ("Apache-2.0", 2, ["ref:Apache-2.0", "apache-comply", "apache-copy?", "apache-url?", "apache-urls?", "apache-asis", "apache-see?"]),
    ("AGPL-3.0-or-later", 2, ["agpl-free", "gpl-warranty?", "agpl-more?", "agpl-copy?", "gpl-see?", "gpl-see-http?"]),
    ("LGPL-2.1-or-later", 2, ["lgpl-free", "lgpl-warranty?", "lgpl-more?"]),
    ("GPL-3.0-or-later", 2, ["gpl-free", "gpl-warranty?", "gpl-more?", "gpl-copy?", "gpl-see?", "gpl-see-http?"]),
    ("GPL-2.0-or-later", 2, ["gpl2-free", "gpl-warranty?", "gpl-more?", "gpl-copy?", "gpl-see?", "gpl-see-http?"]),
    ("Zlib", 1, ["zlib-warranty", "zlib-liability?", "zlib-grant"]),
    ("Unlicense", 1, ["unlicense", "unlicense-use?"]),
    ("MPL-2.0", 1, ["mpl-notice", "mpl-copy?"]),
]
#: What an SPDX line may name beside the names above.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Artistic-2.0", "CC0-1.0", "EPL-1.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT-0", "MPL-1.1", "PostgreSQL", "Unlicense", "WTFPL"]
#: Every known sentence holds one of these words, so that a text without any is not read further.
TRIGGERS = r"licen[sc]e|gpl|\bcc\b|\bcc0\b|permission|permitted|warrant|redistribut|copyright|public|liable|spdx|mpl|anyone is free"

#: The normalisation, in order: pattern and replacement. The patterns mean the same to Java and to RE2.
STEPS = [
    (r"spdx-license-identifier[ \t]*:[ \t]*", "\nspdx="),
    (r"(^|\n)[ \t]*[/*#;%!>-]+[ \t]*", "\n"),
    (r"(^|\n)[ \t]*\(?[0-9a-z][0-9]?\)[ \t]*", "\n"),
    (r"[ \t\r,\"'`()]+", " "),
    (r"[.;:!?]+ ?(\n|$)", "\n"),
    (r"[.;:!?]+ ", "\n"),
    (r" ?\n ?", "\n\n"),
    (r"\n[0-9a-z][0-9]?\n", "\n"),
]
SPDX_WORD = "[a-z0-9][a-z0-9.+-]*"


def normalised(sentence: str) -> str:
    """The words of a sentence as the scan sees them."""
    text = sentence.lower()
    for pattern, by in STEPS:
        text = re.sub(pattern, by, text)
    return re.sub(r"[ \n]+", " ", text).strip()


def known() -> dict[str, str]:
    """Normalised sentence -> identifier."""
    out = {normalised(text): name for name, text in SENTENCES.items()}
    for name, forms in NAMES.items():
        out |= {normalised(phrase.format(form)): f"ref:{name}" for form in forms for phrase in PHRASES}
    return out


def spdx() -> dict[str, str]:
    """A name as an SPDX line gives it, in lower case -> identifier; the words that join names have none."""
    return {name.lower(): f"spdx:{name}" for name in [*NAMES, *SPDX]} | dict.fromkeys(("or", "and", "with"), "")


def sentence_pattern() -> str:
    """One sentence between two line ends: a known one, longer ones first, or else the rest of the line."""
    escape = lambda s: re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", s).replace(" ", "[ \\n]+")
    return "\n ?(" + "|".join(escape(s) for s in sorted(known(), key=lambda s: (-len(s), s))) + "|[^\n]+) ?\n"


def rule_pattern(gap: int, parts: list[str]) -> str:
    """The rule over a string of identifiers in angle brackets."""
    between = f"(?:<[?]>){{0,{gap}}}" if gap else ""
    one = lambda part: "<" + part.rstrip("?").replace(".", "[.]") + ">"
    return one(parts[0]) + "".join(f"(?:{between}{one(p)})?" if p.endswith("?") else between + one(p) for p in parts[1:])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_sentences (known sentences), licenses and unmatched (names and identifiers, sorted, joined by commas)."""
    flow: Column = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    for pattern, by in STEPS:
        flow = F.regexp_replace(flow, pattern, by)
    found = F.regexp_extract_all(flow, F.lit(sentence_pattern()), F.lit(1))
    names, licences = (F.create_map(*map(F.lit, chain.from_iterable(m().items()))) for m in (known, spdx))

    def named(word: Column) -> Column:
        return F.coalesce(licences[F.rtrim(word, F.lit("."))], F.concat(F.lit("spdx:"), F.rtrim(word, F.lit("."))))

    def read_line(s: Column) -> Column:
        words = F.regexp_extract_all(F.substr(s, F.lit(6)), F.lit(SPDX_WORD), F.lit(0))
        return F.array_join(F.transform(F.filter(words, lambda w: named(w) != ""), lambda w: F.concat(F.lit("<"), named(w), F.lit(">"))), "")

    def identified(s: Column) -> Column:
        known_as = F.concat(F.lit("<"), F.coalesce(names[F.regexp_replace(s, r"[ \n]+", " ")], F.lit("?")), F.lit(">"))
        return F.when(F.startswith(s, F.lit("spdx=")), read_line(s)).otherwise(known_as)

    has = F.coalesce(F.lower(text).rlike(TRIGGERS), F.lit(False))
    sequence: Column = F.when(has, F.array_join(F.transform(found, identified), "")).otherwise("")
    out = df.withColumn("__ids", sequence)
    read: Column = F.col("__ids")
    for name, gap, parts in RULES:
        read = F.regexp_replace(read, rule_pattern(gap, parts), "{" + name + "}")
    read = F.regexp_replace(read, "<ref:([^>]*)>", "{$1}")
    read = F.regexp_replace(read, f"<spdx:({'|'.join(n.replace('.', '[.]') for n in [*NAMES, *SPDX])})>", "{$1}")
    out = out.withColumn("__read", read)
    listed = lambda column, pattern: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), F.lit(1)))), ",")
    return (
        out.withColumn("n_sentences", F.regexp_count("__ids", F.lit("<[^?]")).cast("long"))
        .withColumn("licenses", listed(F.col("__read"), r"\{([^}]*)\}"))
        .withColumn("unmatched", listed(F.col("__read"), "<([^>?]+)>"))
        .drop("__ids", "__read")
    )


def oracle_sql(key: str = "doc_id", text: str = "text", source: str = "documents") -> str:
    """The same scan in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    flow = f"chr(10) || lower({text}) || chr(10)"
    for pattern, by in STEPS:
        flow = f"regexp_replace({flow}, {quote(pattern)}, {quote(by)}, 'g')"
    names, licences = ("MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in m().items()) + "}" for m in (known, spdx))
    named = f"coalesce({licences}[rtrim(w, '.')], 'spdx:' || rtrim(w, '.'))"
    line = f"array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(substr(s, 6), {quote(SPDX_WORD)}), lambda w: {named}), lambda n: n <> ''), lambda n: '<' || n || '>'), '')"
    identified = f"CASE WHEN starts_with(s, 'spdx=') THEN {line} ELSE '<' || coalesce({names}[regexp_replace(s, '[ \\n]+', ' ', 'g')], '?') || '>' END"
    read = "ids"
    for name, gap, parts in RULES:
        read = f"regexp_replace({read}, {quote(rule_pattern(gap, parts))}, {quote('{' + name + '}')}, 'g')"
    read = f"regexp_replace({read}, '<ref:([^>]*)>', '{{\\1}}', 'g')"
    read = f"regexp_replace({read}, {quote('<spdx:(' + '|'.join(n.replace('.', '[.]') for n in [*NAMES, *SPDX]) + ')>')}, '{{\\1}}', 'g')"
    listed = lambda pattern: f"array_to_string(list_sort(list_distinct(regexp_extract_all(read, {quote(pattern)}, 1))), ',')"
    return f"""
WITH f AS (SELECT {key}, {text}, CASE WHEN regexp_matches(lower({text}), {quote(TRIGGERS)}) THEN regexp_extract_all({flow}, {quote(sentence_pattern())}, 1) ELSE [] END AS found FROM {source}),
i AS (SELECT {key}, coalesce(array_to_string(list_transform(found, lambda s: {identified}), ''), '') AS ids FROM f),
r AS (SELECT {key}, ids, {read} AS read FROM i)
SELECT {key}, CAST(len(regexp_extract_all(ids, '<[^?]')) AS BIGINT) AS n_sentences, {listed(r'\{([^}]*)\}')} AS licenses, {listed('<([^>?]+)>')} AS unmatched FROM r
"""
