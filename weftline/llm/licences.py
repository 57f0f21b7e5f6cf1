"""Licence scan with a positional index of rare words.

Templates are word sequences with mandatory key phrases: short references and notices, and whole
licences, one template for each of their clauses, so that a clause that was changed or a word
that was put in costs that clause and not the licence. The index has the postings (template,
position) of each template's rarest words by IDF over the templates, as many as a match may lack
words and ``AGREE`` more. A file's rarest licence words are looked up; its place minus the
posting's position is where the template would begin. Postings are intersected: a beginning is a
candidate if ``AGREE`` of them agree on it (fewer where a template is shorter), which every match
does, since it can lack no more words than it may. A candidate is verified: at least ``coverage``
of the template's words stand at their relative positions, and each key phrase stands as a whole
within ``slack`` words of the match.

A row for each match: template and licence, first word and number of words, character
offsets in the text, matched words and their share.

Cases: null, empty and wordless texts match nothing. Texts are scanned whole, however long. A
licence that occurs several times has a row for each place, and places that tie, or overlap, have
a row each. Repeated rows and null ids are scanned each on their own. An empty table gives an
empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table, texts

WORD = re.compile(r"[^\W_]+")
RESULT = "doc_id bigint, template string, licence string, first_word int, words int, start int, end int, matched int, coverage double"


#: Postings that have to agree on where a template begins.
AGREE = 2


@dataclass(frozen=True)
class Config:
    coverage: float = 0.8
    #: Words before and after a match in which a key phrase may stand.
    slack: int = 3



def _clauses(name: str, licence: str, *parts: tuple) -> tuple:
    return tuple((f"{name}-{i + 1}", licence, words, phrases) for i, (words, *phrases) in enumerate(parts))


_BSD = (
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions of source code"),
    ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "redistributions in binary form"),
    ("This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "copyright holders and contributors"),
    ("In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage", "exemplary or consequential damages"),
)
#: Clauses of whole licences.
CLAUSES = (
    *_clauses("mit", "MIT",
        ("to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "sublicense and or sell copies"),
        ("The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "noninfringement"),
        ("In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software", "other dealings in the software"),
    ),
    *_clauses("bsd", "BSD", *_BSD),
    *_clauses("isc", "ISC",
        ("provided that the above copyright notice and this permission notice appear in all copies", "appear in all copies"),
        ("The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "disclaims all warranties"),
        ("In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software", "other tortious action"),
    ),
    *_clauses("zlib", "Zlib",
        ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "redistribute it freely"),
        ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software", "must not be misrepresented"),
        ("If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required", "would be appreciated"),
        ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "plainly marked"),
        ("This notice may not be removed or altered from any source distribution", "removed or altered"),
    ),
    *_clauses("unlicense", "Unlicense",
        ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "anyone is free to copy"),
        ("In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain", "public domain"),
        ("We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors", "heirs and successors"),
        ("We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law", "overt act of relinquishment"),
    ),
    *_clauses("boost", "BSL-1.0",
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", "person or organization"),
        ("The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor", "source language processor"),
    ),
    *_clauses("gpl", "GPL",
        ("either version 2 of the License, or (at your option) any later version", "version 2", "any later version"),
        ("either version 3 of the License, or (at your option) any later version", "version 3", "any later version"),
        ("This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose", "hope that it will be useful"),
        ("You should have received a copy of the GNU General Public License along with this program", "gnu general public license"),
        ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", "verbatim copies"),
    ),
    *_clauses("lgpl", "LGPL",
        ("You should have received a copy of the GNU Lesser General Public License along with this library", "gnu lesser general public license"),
    ),
    *_clauses("agpl", "AGPL-3.0",
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
        ("You should have received a copy of the GNU Affero General Public License along with this program", "gnu affero general public license"),
    ),
    *_clauses("mpl-2", "MPL-2.0",
        ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "copy of the mpl"),
    ),
    *_clauses("apache-2", "Apache-2.0",
        ("without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License", "governing permissions and limitations"),
        ("each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form", "irrevocable copyright license"),
        ("You must cause any modified files to carry prominent notices stating that You changed the files", "prominent notices"),
        ("You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work", "attribution notices"),
        ("This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor", "product names of the licensor"),
    ),
    *_clauses("cc0", "CC0-1.0",
        ("Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of Affirmer's Copyright and Related Rights", "irrevocably and unconditionally waives"),
    ),
    *_clauses("cc-by", "CC-BY",
        ("You must give appropriate credit, provide a link to the license, and indicate if changes were made", "appropriate credit"),
    ),
)

#: (template, licence, words, key phrases)
TEMPLATES = (
    ("mit-short", "MIT", "Released under the MIT License", ("mit license",)),
    ("mit-short-2", "MIT", "Licensed under the MIT license", ("mit license",)),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("free of charge", "without restriction")),
    ("mit-notice", "MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", ("this permission notice",)),
    ("apache-2-short", "Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("apache-2-use", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses",)),
    ("apache-2-as-is", "Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", ("as is basis",)),
    ("gpl-3-work", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-3-short", "GPL-3.0", "Licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-2-short", "GPL-2.0", "Licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-notice", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("lgpl-notice", "LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("agpl-3-short", "AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license",)),
    ("mpl-2-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    ("bsd-redistribution", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd-3-endorse", "BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote",)),
    ("bsd-short", "BSD", "Use of this source code is governed by a BSD-style license", ("bsd",)),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered", "public domain")),
    ("cc0", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    ("cc-by-nc-4-short", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-4-short", "CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4-short", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-4-work", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa-4-work", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    ("boost", "BSL-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    ("zlib-warranty", "Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable", ("held liable",)),
    ("eclipse-2", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("spdx-mit", "MIT", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("spdx-apache-2", "Apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    *CLAUSES,
    ("all-rights", "proprietary", "All rights reserved", ("all rights reserved",)),
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Index:
    def __init__(self, templates=TEMPLATES, cfg: Config = Config()):
        self.cfg, self.templates = cfg, templates
        self.words = [words_of(t[2]) for t in templates]
        self.phrases = [[words_of(p) for p in t[3]] for t in templates]
        df = Counter(w for t in self.words for w in set(t))
        self.idf = {w: math.log(len(templates) / n) for w, n in df.items()}
        self.need = [math.ceil(cfg.coverage * len(w) - 1e-9) for w in self.words]
        self.agree = [min(AGREE, n) for n in self.need]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            for i in sorted(range(len(w)), key=lambda i: (-self.idf[w[i]], i))[: len(w) - self.need[t] + self.agree[t]]:
                self.postings[w[i]].append((t, i))
        self.rare = frozenset(self.postings)

    def candidates(self, words: list[str]) -> list[tuple[int, int]]:
        """(template, place in the file where it would begin) on which enough postings agree."""
        if self.rare.isdisjoint(words):
            return []
        get, agree = self.postings.get, self.agree
        seen = Counter((t, at - i) for at, w in enumerate(words) if w in self.rare for t, i in get(w))
        return sorted(c for c, n in seen.items() if n >= agree[c[0]])

    def verified(self, words: list[str], t: int, d: int) -> tuple[int, int, int] | None:
        """First word, end and matched words of a match."""
        mine, n = self.words[t], len(words)
        lo, hi = max(0, d), min(n, d + len(mine))
        hit = sum(words[k] == mine[k - d] for k in range(lo, hi))
        if hit < self.need[t]:
            return None
        a, z = max(0, d - self.cfg.slack), min(n, d + len(mine) + self.cfg.slack)
        near = " " + " ".join(words[a:z]) + " "
        if any(" " + " ".join(p) + " " not in near for p in self.phrases[t]):
            return None
        return lo, hi, hit

    def matches(self, text: str | None) -> list[tuple]:
        words = words_of(text)
        found = [(t, got) for t, d in self.candidates(words) if (got := self.verified(words, t, d))]
        if not found:
            return []
        low = text.lower()
        if len(low) == len(text):
            at = [m.span() for m in WORD.finditer(low)]
        else:  # lower-casing changed the length
            back = [i for i, c in enumerate(text) for _ in c.lower()]
            at = [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer(low)]
        return [(self.templates[t][0], self.templates[t][1], lo, hi - lo, at[lo][0], at[hi - 1][1], hit, round(hit / len(self.words[t]), 6)) for t, (lo, hi, hit) in found]


def scan(docs: DataFrame, templates=TEMPLATES, cfg: Config = Config()) -> DataFrame:
    """One row of ``RESULT`` for each match; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, cfg)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        for batch in batches:
            rows = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), texts(batch, "text")) for m in index.matches(t)]
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "template", "licence", "first_word", "words", "start", "end", "matched", "coverage"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, RESULT)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence passage in the documents."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql(templates=TEMPLATES, cfg: Config = Config()) -> str:
    """The same rows in DuckDB: every alignment of every template, without an index."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(a)}, {quote(b)}, {quote(' '.join(words_of(w)))}, [{', '.join(quote(' ' + ' '.join(words_of(p)) + ' ') for p in ps)}])" for a, b, w, ps in templates)
    return rf"""
with tpl as (
  select template, licence, string_split(body, ' ') tw, phrases from (values {rows}) v(template, licence, body, phrases)
), tword as (
  select template, i::bigint i, tw[i + 1] w from tpl, unnest(range(0, len(tw))) r(i)
), doc as (
  select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') dw,
         string_split_regex(lower(text), '[\p{{L}}\p{{N}}]+') ds from documents where text is not null
), dword as (
  select doc_id, k::bigint k, dw[k + 1] w from doc, unnest(range(0, len(dw))) r(k)
), hit as (
  select doc_id, template, k - i d, count(*) matched from dword join tword using (w) group by all
), judged as (
  select doc_id, template, licence, matched, len(tw) n, phrases, dw, ds, greatest(0, d) lo, least(len(dw), d + len(tw)) hi,
         ' ' || array_to_string(dw[greatest(0, d - {cfg.slack}) + 1 : least(len(dw), d + len(tw) + {cfg.slack})], ' ') || ' ' near
  from hit join tpl using (template) join doc using (doc_id)
  where matched >= ceil({cfg.coverage} * len(tw) - 1e-9)
)
select doc_id, template, licence, lo::integer first_word, (hi - lo)::integer words,
       (list_sum(list_transform(ds[1 : lo + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(dw[1 : lo], lambda x: length(x))), 0))::integer "start",
       (list_sum(list_transform(ds[1 : hi], lambda x: length(x))) + list_sum(list_transform(dw[1 : hi], lambda x: length(x))))::integer "end",
       matched::integer matched, round(matched / n, 6)::double coverage
from judged where len(list_filter(phrases, lambda p: not contains(near, p))) = 0
"""
