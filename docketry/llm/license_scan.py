"""Operator 6, license scan by conditional compression.

For each template, the windows of SLACK more than twice its length that hold enough of its words (all windows
that could be confirmed) are compressed as they are and once more with the template as zstandard raw dictionary. Places
where the template saves bytes and of whose words few are lacking are ranked by what is saved, over all templates: of
places that overlap, the greatest saving is looked at first. It is confirmed by the exact differences of wording: a word that
tells licenses apart (a version, NC, SA, ND, Lesser, Affero ...) may be neither lacking nor altered nor added; if it
is, the next in rank is looked at. Every confirmed place is a row, however its lines are wrapped. Lines with license
wording further from all of these than their template's length are reported with a null license, in blocks of
lines at most the longest template's length apart.

Each document is scanned alone, whole, in slices of Arrow batches. Texts are passed over before Python sees them only
where no place can be: of each template so many of its words are asked for that a text without any of them lacks more
than a place may (`sure_words`), and without the wording in CUES. Nothing shuffles.

Defined results: null and empty texts have no blocks, so no rows; several places give several rows, numbered
from 0 in order of line; of equal savings the first template in order wins; repeated rows give repeated results; extra columns are
ignored; a block in any case and with any white space is compared in lower case, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

SLACK = 8
MISSING = 0.15
CUES = ("licen", "copyright", "spdx", "redistribut", "permission is hereby", "public domain", "warranties", "agpl", "lgpl", "gnu gpl")
#: Words that tell one license from another, and words after which a number is a version.
DECIDING = frozenset("affero agpl apache bsd cc0 clause gpl isc lesser lgpl library mit mozilla mpl nc nd noderivatives noderivs noncommercial sa sharealike zlib".split())
BEFORE_VERSION = frozenset("version v license licence gpl lgpl agpl gnu apache mozilla mpl bsd by cc nc sa nd attribution noncommercial sharealike noderivatives".split())
NUMBER = re.compile(r"[0-9]+(?:[.][0-9]+)*")
WORD = re.compile(r"[^\W_]+(?:[.][^\W_]+)*")

#: Public license notices, by SPDX name. Several notices may name one license.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", "MIT License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the copyright holder."),
)


def with_identifiers(templates: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """The templates and, for each name, the line that names it by its SPDX identifier."""
    return templates + tuple((n, f"SPDX-License-Identifier: {n}") for n in dict.fromkeys(n for n, _ in templates))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def sure_words(templates: tuple[tuple[str, str], ...]) -> list[str]:
    """Words of which any confirmed place of any template holds one: of each template so many occurrences as may be
    lacking and one more, the longest words first, those that are asked for already before others."""
    asked: dict[str, None] = {}
    for own in sorted((words(t) for _, t in templates), key=len):
        need = int(MISSING * len(own)) + 1
        for w in sorted(set(own), key=lambda w: (w not in asked, -len(w), w)):
            if need > 0:
                asked[w] = None
                need -= own.count(w)
    return list(asked)


def telling(own: list[str], at: int) -> bool:
    """Whether the word at this place tells licenses apart."""
    w = own[at]
    return w in DECIDING or bool(NUMBER.fullmatch(w) and ("." in w or (at and own[at - 1] in BEFORE_VERSION)))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        templates = with_identifiers(templates)
        self.names = [n for n, _ in templates]
        self.words = [words(t) for _, t in templates]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        dicts = [zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for w in self.words]
        self.primed = [zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in dicts]

    def rank(self, block: str) -> list[tuple[int, int]]:
        """(saving in bytes, template), best first."""
        data = " ".join(words(block)).encode()
        whole = len(self.plain.compress(data))
        return sorted(((whole - len(c.compress(data)), i) for i, c in enumerate(self.primed)), key=lambda x: (-x[0], self.names[x[1]], x[1]))

    def saving(self, block: list[str], i: int) -> int:
        data = " ".join(block).encode()
        return len(self.plain.compress(data)) - len(self.primed[i].compress(data))

    def differences(self, block: list[str], template: list[str]) -> tuple[list[str], int, int, bool]:
        """Template words that the block lacks; the block's span from first to last matching word; whether the words
        that tell licenses apart are the same in both."""
        met, own, start, end = [False] * len(template), [False] * len(block), len(block), 0
        for a, b, n in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks():
            if n:
                met[b : b + n] = [True] * n
                own[a : a + n] = [True] * n
                start, end = min(start, a), max(end, a + n)
        same = not any(telling(template, k) for k, m in enumerate(met) if not m) and not any(telling(block, k) for k in range(start, end) if not own[k])
        return [w for w, m in zip(template, met, strict=True) if not m], min(start, end), end, same

    def places(self, own: list[str], i: int) -> Iterator[tuple[int, int, int, list[str], bool]]:
        """(start, end, saving, lacking words, whether it is confirmed) of each place of template i among the words."""
        template = self.words[i]
        n, known = len(template), set(template)
        width, most = 2 * n + SLACK, MISSING * n
        upto = np.cumsum([0, *(w in known for w in own)])
        at = np.arange(len(own))
        likely = np.flatnonzero(upto[np.minimum(at + width, len(own))] - upto[at] >= n - most)
        k = 0
        while k < len(likely):
            p = int(likely[k])
            best = None
            if self.saving(own[p : p + width], i) > 0:
                for _ in range(2):  # again from the first word met, so that the window holds the whole notice
                    lacking, start, end, same = self.differences(own[p : p + width], template)
                    if len(lacking) <= most and (best is None or len(lacking) <= len(best[2])):
                        best = (p + start, p + end, lacking, same)
                    p += start
            if best:
                yield best[0], best[1], self.saving(own[best[0] : best[1]], i), *best[2:]
            k = int(np.searchsorted(likely, best[1] if best else int(likely[k]) + max(1, n // 4)))

    def scan(self, text: str | None) -> Iterator[tuple]:
        """(block, first_line, last_line, license, saving, missing, extra, missing_words) for each place."""
        low = (text or "").lower()
        lines = low.split("\n")
        cues = [i for i, line in enumerate(lines) if any(c in line for c in CUES)]
        met = list(WORD.finditer(low))
        own = [m.group() for m in met]
        breaks = np.cumsum([len(x) + 1 for x in lines])
        line_of = np.searchsorted(breaks, [m.start() for m in met], side="right")
        taken, rows = np.zeros(len(own), bool), []
        near = np.zeros(len(lines), bool)  # lines that belong to a place
        found = [(-x[2], i, *x) for i in range(len(self.names)) for x in self.places(own, i)]
        for _, i, start, end, saving, lacking, same in sorted(found, key=lambda x: x[:4]):
            if same and not taken[start:end].any():
                taken[start:end] = True
                n = len(self.words[i])
                near[line_of[max(0, start - n)] : line_of[min(len(own) - 1, end + n)] + 1] = True
                rows.append((int(line_of[start]), int(line_of[end - 1]), start, self.names[i], saving, len(lacking), end - start - (n - len(lacking)), " ".join(lacking)))
        longest = max(map(len, self.words))
        first = last = None
        for i in [*(i for i in cues if not near[i]), None]:
            if last is not None and (i is None or np.searchsorted(line_of, i) - np.searchsorted(line_of, last + 1) > longest):
                rows.append((first, last, int(np.searchsorted(line_of, first)), None, 0, 0, 0, ""))
                first = None
            first, last = i if first is None else first, i
        for n, (first, last, _, *rest) in enumerate(sorted(rows, key=lambda r: (r[0], r[2]))):
            yield (n, first, last, *rest)


SCHEMA = "doc_id long, block int, first_line int, last_line int, license string, saving int, missing int, extra int, missing_words string"


def read_templates(table: DataFrame) -> tuple[tuple[str, str], ...]:
    """The templates of a table (name, text), which is a parameter of a few hundred rows, by name and text."""
    return tuple((r.name, r.text) for r in table.select("name", "text").filter("name is not null and text is not null").distinct().orderBy("name", "text").collect())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per confirmed place, and per block of other license wording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates)
        kinds = [pa.int64(), *[pa.int32()] * 3, pa.string(), *[pa.int32()] * 3, pa.string()]
        for whole in batches:
            for b in slices(whole, 1):
                rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in s.scan(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split(" ")[0] for c in SCHEMA.split(", ")])

    asked = [*CUES, *(w for w in sure_words(with_identifiers(templates)) if not any(c in w for c in CUES))]
    some = F.lit(False)
    for c in asked:
        some = some | F.col("low").contains(c)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("low", F.lower("text"))
    return texts.filter(some).select("doc_id", "text").mapInArrow(run, SCHEMA)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
