"""Licence scan: Dice coefficient over word bigrams.

Text and licence templates are normalised to lower-case words of letters and
digits and compared as sets of word bigrams: ``2 * |A & B| / (|A| + |B|)``.
Two units of a document are compared: the whole text, and inside it every
passage of a template's length. Size bounds prune first: a unit of a bigrams
can reach the threshold t only against templates of t / (2 - t) * a to
(2 - t) / t * a bigrams, and a passage only if at least that share of the
template's bigrams occurs in the text at all.

Templates are given (they do not grow with the data) and travel with the task.
Texts are read once, nothing is shuffled.

Where passages overlap, the one with the most common bigrams less those that
differ stays (a whole licence before a notice inside it).

Defined results: null, empty and word-less texts have no licence; ties go to
the larger overlap, then to the first licence by name; repeated rows are
scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from costlens.llm import hashing
from costlens.llm.common import small_batches
from costlens.llm.licence_texts import TEXTS

# Published licence texts and notices, by SPDX name.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD 2-Clause License.",
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _gnu(kind: str, version: str, work: str = "This program") -> str:
    """The usual notice of the GNU licences."""
    thing = work.split()[-1]
    return (
        f"{work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {work} is distributed in the "
        f"hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this {thing}"
    )


def _gnu_notices(kind: str, version: str, work: str = "This program") -> list[str]:
    whole = _gnu(kind, version, work)
    first = whole[: whole.index(" " + work + " is distributed")]
    return [
        first,
        first.replace(", or (at your option) any later version.", "."),
        whole + ". If not, see <https://www.gnu.org/licenses/>.",
        whole + "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
        f"This work is licensed under the GNU {kind}, version {version}.",
    ]


_CC = "This work is licensed under a Creative Commons {} International License."
_NOTICES: dict[str, list[str]] = {
    "AGPL-3.0": _gnu_notices("Affero General Public License", "3"),
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _CC.format("Attribution-NoDerivatives 4.0"), _CC.format("Attribution-NoDerivs 4.0")],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", _CC.format("Attribution-NonCommercial-ShareAlike 4.0")],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", _CC.format("Attribution-NonCommercial-NoDerivatives 4.0")],
    "GPL-2.0": _gnu_notices("General Public License", "2"),
    "GPL-3.0": _gnu_notices("General Public License", "3"),
    "LGPL-2.1": _gnu_notices("Lesser General Public License", "2.1", "This library"),
    "LGPL-3.0": _gnu_notices("Lesser General Public License", "3") + _gnu_notices("Lesser General Public License", "3", "This library"),
}
for _name, _more in _NOTICES.items():
    TEMPLATES.setdefault(_name, []).extend(x for x in _more if x not in TEMPLATES.get(_name, []))
for _name, _text in TEXTS.items():
    TEMPLATES[_name].append(_text)
# End of the fixed values.

#: Lookup bits for the templates' bigrams.
_BITS = 22


def bigrams(text: np.ndarray) -> tuple[np.ndarray, int]:
    """Hashes of the word bigrams in order (a single word is its own), and
    the number of words."""
    h, _, _ = hashing.word_hashes(hashing.lower_ascii(text), hashing.ALPHANUMERIC)
    return hashing.sequence_hashes(h, min(2, len(h))) if len(h) else h, len(h)


class Template:
    def __init__(self, name: str, text: str):
        order, self.words = bigrams(np.frombuffer(text.encode(), dtype=np.uint8))
        self.name, self.grams = name, np.unique(order)
        self.length = len(order)


def best_passage(order: np.ndarray, at: np.ndarray, template: Template, threshold: float) -> tuple[float, int, int, int] | None:
    """Dice, first and last bigram and net overlap of the passage of the
    template's length that is most like it, or None below the threshold.
    ``at`` are the places of the template's bigrams."""
    size = len(template.grams)
    need = threshold / (2 - threshold) * size
    if len(at) < need:
        return None
    best = None
    # Passages that begin with a bigram of the template.
    hits = np.searchsorted(at, at + template.length) - np.arange(len(at))
    for i in np.flatnonzero(hits >= need).tolist():
        # No passage has more common bigrams than hits.
        top = min(int(hits[i]), size)
        if best is not None and 2 * top / (top + size) <= best[0]:
            continue
        start = int(at[i])
        unit = np.unique(order[start : start + template.length])
        both = len(np.intersect1d(unit, template.grams, assume_unique=True))
        dice = 2 * both / (len(unit) + size)
        if dice >= threshold and (best is None or dice > best[0]):
            best = (dice, start, min(start + template.length, len(order)), 3 * both - len(unit) - size)
    return best


def licences_of(text: np.ndarray | None, templates: list[Template], known: np.ndarray, threshold: float) -> tuple[int, list[dict]]:
    if text is None:
        return 0, []
    order, words = bigrams(text)
    if not words:
        return 0, []
    found: list[dict] = []
    some = np.flatnonzero(known[order >> np.uint64(65 - len(known).bit_length())])
    if not len(some):
        return words, []
    grams = order[some]
    whole = None
    for t in templates:
        low, high = threshold / (2 - threshold) * len(t.grams), (2 - threshold) / threshold * len(t.grams)
        if len(some) < low:
            continue
        options = []
        if whole is None and low <= len(order):
            whole = np.unique(order)
        if whole is not None and low <= len(whole) <= high:
            both = len(np.intersect1d(whole, t.grams, assume_unique=True))
            options.append((2 * both / (len(whole) + len(t.grams)), 0, len(order), 3 * both - len(whole) - len(t.grams)))
        passage = best_passage(order, some[np.isin(grams, t.grams)], t, threshold)
        if passage:
            options.append(passage)
        for dice, start, end, net in options:
            if dice >= threshold:
                found.append({"licence": t.name, "dice": dice, "start_word": start, "end_word": min(end + 1, words), "grams": len(t.grams), "net": net})
    # Of passages that overlap, the one stays that explains most: its common
    # bigrams less those that differ. So a whole text goes before a notice that
    # is a part of it, and among neighbours of like length the likest stays.
    kept: list[dict] = []
    for x in sorted(found, key=lambda x: (-x["net"], -x["dice"], x["licence"])):
        if not any(x["start_word"] < k["end_word"] and k["start_word"] < x["end_word"] for k in kept):
            kept.append(x)
    # Each licence once, at its likest place.
    ranked: dict[str, dict] = {}
    for x in sorted(kept, key=lambda x: (-x["dice"], -x["grams"], x["licence"])):
        ranked.setdefault(x["licence"], x)
    return words, [{k: x[k] for k in ("licence", "dice", "start_word", "end_word")} for x in ranked.values()]


def _task(texts: dict[str, list[str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [Template(name, t) for name in sorted(texts) for t in texts[name]]
        known = np.zeros(1 << _BITS, dtype=bool)
        for t in templates:
            known[t.grams >> np.uint64(64 - _BITS)] = True
        kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())]))
        for batch in batches:
            rows = [licences_of(t, templates, known, threshold) for t in hashing.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([f[0]["licence"] if f else None for _, f in rows], pa.string()),
                    pa.array([round(f[0]["dice"], 6) if f else None for _, f in rows], pa.float64()),
                    pa.array([f for _, f in rows], kind),
                ],
                ["doc_id", "n_words", "licence", "dice", "licences"],
            )

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.85) -> DataFrame:
    """One row per document: doc_id, n_words, its likest licence and Dice
    (null if none), and every licence found with its place in words."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _task(templates or TEMPLATES, threshold),
        f"doc_id {kind}, n_words long, licence string, dice double, "
        "licences array<struct<licence:string,dice:double,start_word:long,end_word:long>>",
    )
