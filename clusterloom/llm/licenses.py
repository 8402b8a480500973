"""License scans: base phrases, and template markup compiled to token automata.

A template is wording with marks: ``<<optional>> ... <<end>>`` encloses words that may be left out,
``<<any n>>`` stands for up to n words of any wording.  It compiles to states with one step for each
word, free steps around optional parts and word-by-word steps through replaceable ones.  A text is
accepted where every mandatory word stands in its place; the longest acceptance from a start is
taken and the search goes on behind it.

Defined cases: a null text is empty: no words, no places, score 0; places of one phrase may overlap
others and each counts; repeated rows are scanned each; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clusterloom.llm.common import alnum_words, raw, text_frame

#: Phrases and labels as the contract fixes them.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
_LIABLE = "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the
    following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice
    this list of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce
    the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
    materials provided with the distribution"""
_BSD_END = """this software is provided by <<any 8>> as is and any express or implied warranties including but not limited to the
    implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any 8>> be
    liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
    procurement of substitute goods or services loss of use data or profits or business interruption however caused and on
    any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any
    way out of the use of this software even if advised of the possibility of such damage"""
_GNU = "gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license"

#: License texts in full, the headers that licenses ask files to carry (``-header``), and
#: the usual one-line notices (``-notice``), in template markup.  All mandatory words must be there, to the end.
TEMPLATES = {
    "MIT": f"""permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files <<optional>>the software<<end>> to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the
        following conditions the above copyright notice and this permission notice <<optional>>including the next
        paragraph<<end>> shall be included in all copies or substantial portions of the software the software is
        provided as is {_AS_IS} in no event shall the authors or copyright holders {_LIABLE}""",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"""{_BSD} <<optional>>3<<end>> neither the name of <<any 12>> nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}""",
    "ISC": """permission to use copy modify and or distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies the
        software is provided as is and <<any 6>> disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall <<any 6>> be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
        contract negligence or other tortious action arising out of or in connection with the use or performance of this
        software""",
    "Zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software for
        any purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions <<optional>>1<<end>> the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation
        would be appreciated but is not required <<optional>>2<<end>> altered source versions must be plainly marked as such
        and must not be misrepresented as being the original software <<optional>>3<<end>> this notice may not be removed or
        altered from any source distribution""",
    "Unlicense": f"""this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain we make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law the software is provided as is {_AS_IS} in no event shall the authors {_LIABLE}""",
    "Apache-2.0-header": """licensed under the apache license version 2 0 <<optional>>the license<<end>> you may not use this
        file except in compliance with the license you may obtain a copy of the license at <<any 12>> unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language
        governing permissions and limitations under the license""",
    "GPL-header": f"""free software you can redistribute it and or modify it under the terms of the {_GNU} as published by
        the free software foundation either version <<any 2>> of the license or <<optional>>at your option<<end>> any later
        version <<any 5>> is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the {_GNU} for more details""",
    "MPL-2.0-header": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the
        mpl was not distributed with this file you can obtain one at <<any 8>>""",
    "MIT-notice": "<<optional>>released<<end>> <<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> mit license",
    "Apache-2.0-notice": "licensed under the apache license <<optional>>version 2 0<<end>>",
    "GPL-notice": f"licensed under the {_GNU} <<optional>>version <<any 1>><<end>>",
    "CC-notice": "licensed under <<optional>>a creative commons<<end>> cc by <<optional>>nc<<end>> <<optional>>sa<<end>> <<optional>>nd<<end>> <<any 2>>",
}


class Automaton:
    """Token automaton of one template; state 0 starts, the last state accepts."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.anything: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        text = template.replace("<<", " <<").replace(">>", ">> ").replace("<<any ", "<<any_")
        at = 0
        for token in text.lower().split():
            if token == "<<optional>>":
                opened.append(at)
            elif token == "<<end>>":
                self.free[opened.pop()].append(at)
            elif token.startswith("<<any_"):
                begin = at
                for _ in range(int(token[6:-2])):
                    nxt = self._state()
                    self.anything[at] = nxt
                    at = nxt
                end = self._state()
                for state in range(begin, end):
                    self.free[state].append(end)
                at = end
            else:
                nxt = self._state()
                self.words[at][token.encode()] = nxt
                at = nxt
        if opened:
            raise ValueError("an optional part of the template never ends")
        self.accept = at
        self.closed = [self._closure(s) for s in range(len(self.words))]
        self.begins = frozenset(w for s in self.closed[0] for w in self.words[s])
        if self.accept in self.closed[0] or any(self.anything[s] is not None for s in self.closed[0]):
            raise ValueError("a template begins with mandatory or optional wording and has some mandatory word")
        self.needs = self._needed()

    def _state(self) -> int:
        self.words.append({})
        self.anything.append(None)
        self.free.append([])
        return len(self.words) - 1

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def _needed(self) -> bytes:
        """The longest word without which the template can't accept."""
        best = b""
        for state, words in enumerate(self.words):
            for w, nxt in words.items():
                skipped = any(a <= state and b >= nxt for a, free in enumerate(self.free) for b in free)
                if not skipped and len(w) > len(best):
                    best = w
        return best

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted stretch from ``start``, or -1."""
        states, end = self.closed[0], -1
        for at in range(start, len(words)):
            word, nxt = words[at], set()
            for s in states:
                if (t := self.words[s].get(word)) is not None:
                    nxt |= self.closed[t]
                if (t := self.anything[s]) is not None:
                    nxt |= self.closed[t]
            if not nxt:
                break
            states = nxt
            if self.accept in states:
                end = at + 1
        return end

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(words):
            if words[at] in self.begins and (end := self.longest(words, at)) > at:
                yield at, end
                at = end
            else:
                at += 1


@lru_cache(maxsize=None)
def automata() -> dict[str, Automaton]:
    return {name: Automaton(template) for name, template in TEMPLATES.items()}


#: Phrases by their last word but with all words in order.
_PHRASES = [(phrase.encode().split(), label) for phrase, label in PHRASES.items()]


def scan(text: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Number of words, base places and template places as (start, end, label), in order of start."""
    words = alnum_words(text)
    have = set(words)
    base, found = [], []
    if b"license" in have:
        at = -1
        while True:
            try:
                at = words.index(b"license", at + 1)
            except ValueError:
                break
            for phrase, label in _PHRASES:
                begin = at + 1 - len(phrase)
                if begin >= 0 and words[begin : at + 1] == phrase:
                    base.append((begin, at + 1, label))
    for name, automaton in automata().items():
        if automaton.needs in have:
            found += [(a, b, name) for a, b in automaton.find(words)]
    return len(words), sorted(base), sorted(found)


def _covered(places: list[tuple[int, int, str]]) -> int:
    total, last = 0, 0
    for a, b, _ in sorted(places):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total


PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, base, found, score = [], [], [], []
        for text in raw(batch.column(1)):
            words, b, f = scan(text)
            n.append(words)
            base.append([{"start": x, "end": y, "label": z} for x, y, z in b])
            found.append([{"start": x, "end": y, "label": z} for x, y, z in f])
            score.append(_covered(b + f) / words if words else 0.0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(base, PLACES), pa.array(found, PLACES), pa.array(score, pa.float64())],
            names=["id", "n_words", "base", "templates", "score"],
        )


def license_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, templates, score): places as (start, end, label) by word; the score is the
    share of the words that some place covers."""
    place = "array<struct<start:long,end:long,label:string>>"
    return text_frame(docs, id_col, text_col).mapInArrow(_scanned, f"id long, n_words long, base {place}, templates {place}, score double")


def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_places(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = "array_join(array_sort(array_distinct({})), ',')"
    return found.selectExpr(
        "id AS doc_id",
        "n_words",
        "CAST(size(base) AS LONG) AS n_base",
        "array_min(base.start) AS first_word",
        "array_max(base.start) AS last_word",
        labels.format("base.label") + " AS base_labels",
        labels.format("concat(base.label, templates.label)") + " AS labels",
        "score",
    )
