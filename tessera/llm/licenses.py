"""License scans by template-markup matching.

A template is wording with marked regions: <<beginOptional>>...<<endOptional>> may be
left out, <<var;words=a-b>> stands for a to b words of any kind. All templates are
compiled into one token automaton, made deterministic as its states are met. A place
matches where the words from there on follow the automaton to an end: mandatory wording
must be the same, word for word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, binary, map_rows, tune

#: Base phrases and their labels.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices, first sentences ("-start") and whole licenses in template markup.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var;words=1-8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>> <<beginOptional>>3<<endOptional>> neither the name of <<var;words=1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <<endOptional>> this software is provided by <<var;words=1-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;words=1-8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-start": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-notice": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by <<beginOptional>>nc<<endOptional>> <<beginOptional>>nd<<endOptional>> <<beginOptional>>sa<<endOptional>> <<var;words=1-1>> 0 <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>",
    "copyright-notice": "copyright <<beginOptional>>c<<endOptional>> <<var;words=1-8>> all rights reserved",
    "gpl-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license <<beginOptional>>version <<var;words=1-1>> <<beginOptional>>or later<<endOptional>> <<endOptional>>",
    "isc": "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;words=1-8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;words=1-8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "isc-start": "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<var;words=1-2>> in no event shall <<var;words=1-12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-notice": "released under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-start": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction <<beginOptional>>including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software<<endOptional>>",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<var;words=1-8>>",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this is free and unencumbered software released into the public domain",
}

_MARK = re.compile(r"<<(.*?)>>|([^\s<]+)")
#: Word characters: digits, letters (lower-cased) and all bytes beyond ASCII.
_WORDS = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else 32 for c in ASCII_LOWER)


def words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased."""
    return text.translate(_WORDS).split()


class Automaton:
    """Token automaton of several templates: step(state, word) and ends[state], the labels that end there."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.on: list[dict[bytes, list[int]]] = []  # by node, the nodes after a word
        self.any: list[list[int]] = []  # those after any word
        self.free: list[list[int]] = []  # those after no word
        self.label: dict[int, str] = {}
        first = self._node()
        for name, text in templates.items():
            begin = self._node()
            self.free[first].append(begin)
            self.label[self._build(text, begin)] = name
        self.states: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.steps: list[dict[bytes, int]] = []
        self.ends: list[tuple[str, ...]] = []
        self.start = self._state({first})
        self.seeds = self._seeds()

    def _node(self) -> int:
        self.on.append({})
        self.any.append([])
        self.free.append([])
        return len(self.on) - 1

    def _build(self, text: str, at: int) -> int:
        open_at: list[int] = []
        for mark, word in _MARK.findall(text):
            nxt = self._node()
            if word:
                self.on[at].setdefault(word.encode(), []).append(nxt)
            elif mark == "beginOptional":
                open_at.append(at)
                self.free[at].append(nxt)
            elif mark == "endOptional":
                self.free[at].append(nxt)
                self.free[open_at.pop()].append(nxt)
            elif m := re.fullmatch(r"var;words=(\d+)-(\d+)", mark):
                for k in range(int(m[2])):
                    if k >= int(m[1]):
                        self.free[at].append(nxt)
                    step = self._node()
                    self.any[at].append(step)
                    at = step
                self.free[at].append(nxt)
            else:
                raise ValueError(f"unknown mark <<{mark}>>")
            at = nxt
        if open_at:
            raise ValueError("an optional region is not closed")
        return at

    def _state(self, nodes: set[int]) -> int:
        todo, full = list(nodes), set(nodes)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in full:
                    full.add(n)
                    todo.append(n)
        key = frozenset(full)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.ends.append(tuple(sorted({self.label[n] for n in full if n in self.label})))
        return self.states[key]

    def step(self, state: int, word: bytes) -> int:
        """The next state, or -1."""
        known = self.steps[state]
        if (nxt := known.get(word)) is None:
            nodes = {n for s in self.sets[state] for n in (*self.on[s].get(word, ()), *self.any[s])}
            nxt = self._state(nodes) if nodes else -1
            if nxt < 0 or any(word in self.on[s] for s in self.sets[state]):
                if len(known) < 4096:  # other words are as good as each other
                    known[word] = nxt
        return nxt

    def _seeds(self) -> list[bytes]:
        """Every match begins with one of these: the first two words, or the first where any may follow."""
        found = set()
        for s in self.sets[self.start]:
            if self.any[s]:
                raise ValueError("a template begins with a replaceable region")
            for w in self.on[s]:
                after = self.sets[self._state(set(self.on[s][w]))]
                if any(self.any[n] or n in self.label for n in after):
                    found.add(b" " + w + b" ")
                else:
                    found |= {b" " + w + b" " + x + b" " for n in after for x in self.on[n]}
        return sorted(found)

    def scan(self, found: list[bytes]) -> list[tuple[str, int, int]]:
        """(label, first word, words) of each place, the longest of each label; ordered."""
        line = b" " + b" ".join(found) + b" "
        at: set[int] = set()
        for seed in self.seeds:
            i = line.find(seed)
            while i >= 0:
                at.add(i)
                i = line.find(seed, i + 1)
        out, k, before = [], 0, 0
        for i in sorted(at):
            k += line.count(b" ", before, i)
            before = i
            state, longest = self.start, {}
            for n in range(k, len(found)):
                if (state := self.step(state, found[n])) < 0:
                    break
                for label in self.ends[state]:
                    longest[label] = n + 1 - k
            out += [(label, k, n) for label, n in sorted(longest.items())]
        return out


@lru_cache(maxsize=4)
def _automaton(items: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(dict(items))


def covered(places: list[tuple[str, int, int]]) -> int:
    """Words in at least one place."""
    total = end = 0
    for _, at, n in sorted(places, key=lambda p: p[1]):
        total += max(0, at + n - max(at, end))
        end = max(end, at + n)
    return total


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """(key, n_words, places): the places of templates in every whole text.

    places: array of (label, start, words), start in words from 0, by start and label.
    Null and empty texts have no words. One row for each input row, repeated ones too;
    other columns are not read, so clashing names do no harm. Work and memory follow the
    text: no shuffle.
    """
    tune(df.sparkSession)
    items = tuple(((BASE if base is None else base) | (TEMPLATES if templates is None else templates)).items())
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        auto = _automaton(items)
        n, out = [], []
        for t in binary(b.column(1)):
            w = words(t)
            n.append(len(w))
            out.append([{"label": x, "start": s, "words": k} for x, s, k in auto.scan(w)])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(out, place)], ["key", "n_words", "places"])

    got = map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")), run, "key long, n_words long, places array<struct<label: string, start: long, words: long>>")
    return got.withColumnRenamed("key", key)


def report(found: DataFrame, key: str = "doc_id", base: dict[str, str] | None = None) -> DataFrame:
    """The digest of scan(): counts, ends and labels of base places, all labels, and the share of words in places."""
    names = F.array(*[F.lit(x) for x in (BASE if base is None else base)])
    of_base = F.filter("places", lambda p: F.array_contains(names, p["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda p: p["label"]))), ",")
    # Places are in order of start: the words of each that lie beyond all earlier ends.
    end = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end")),
        lambda acc, p: F.struct(
            (acc["total"] + F.greatest(F.lit(0).cast("long"), p["start"] + p["words"] - F.greatest(p["start"], acc["end"]))).alias("total"),
            F.greatest(acc["end"], p["start"] + p["words"]).alias("end"),
        ),
    )["total"]
    starts = F.transform(of_base, lambda p: p["start"])
    return found.select(
        key,
        "n_words",
        F.size(of_base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.when(F.col("n_words") > 0, end / F.col("n_words")).otherwise(0.0).alias("score"),
        F.size("places").cast("long").alias("n_places"),
    )
