"""Operator 6: license texts, by an exact set-similarity join of text blocks with templates.

A block is a line, or a window of consecutive words; it matches a template when it holds at least `containment` of the
template's distinct words, all words that tell the template from its siblings, and none that tell a sibling from it
(NAMED): one license's name is a fifth of a short notice and so the word that could else be missing. Windows are as long as the
template, and longer by the share that may be missing, so that as many words may stand between as may be left out. They are for texts that
are wrapped, and for lines longer than a window, in which words of a template may stand far apart.
Lines count first: a window counts where it doesn't touch a line that matches the template alone.
The words of all templates are put into one global order by how many documents hold them, rarest first; those
frequencies are counted over all documents and there are only as many as the templates have words. Then
  length filter    a block with fewer distinct words than the template needs is left at once;
  prefix filter    of a template with n words that needs m, one of the n - m + 1 rarest must be in the block;
  positional       a template first met at its word number i can match in n - i words at most;
and the few candidates that are left are verified on the full sets. So nothing above the threshold is missed.
The same filters on a whole document's words tell which templates its windows can match; for these two pointers go
over the places of the template's words.
Templates are a parameter and bounded; documents stream through, with no shuffle but that of the word counts.

Beside this, each place where a phrase's words stand consecutively counts for the phrase's label.

Defined cases: a null text is empty; repeated rows get the same labels; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import own_columns

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that stand consecutively, and their label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and text of each template. Short notices, grants that name a license, and whole license texts.
TEMPLATES = (
    ("notice-mit", "Released under the MIT License."),
    ("notice-apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("notice-gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("notice-cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("grant-mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("grant-apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("grant-gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("grant-bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("grant-cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "text-mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "text-isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "text-bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "text-zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
)
CONTAINMENT = 0.8
_OTHER_GPL, _OTHER_CC = ("lesser", "affero", "library", "lgpl", "agpl"), ("noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd")
#: The words that a block must hold for a template, and those that it must not.
NAMED = {
    "notice-mit": (("mit",), ()),
    "notice-apache-2.0": (("apache", "2"), ()),
    "notice-gpl-3.0": (("general", "3"), _OTHER_GPL),
    "notice-cc-by-nc-4.0": (("by", "nc", "4"), ("sa", "nd")),
    "grant-apache-2.0": (("apache", "2"), ()),
    "grant-gpl": (("general",), _OTHER_GPL),
    "grant-cc-by": (("attribution", "4"), _OTHER_CC),
}

_FOLD = str.maketrans(UPPER, LOWER)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(_FOLD))


def needed(n: int, containment: float) -> int:
    """How many of n words a block must hold; exact for decimal thresholds."""
    return max(1, -(-round(containment * 10**6) * n // 10**6))


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the vocabulary occurs. The result has no more rows than the vocabulary."""
    wanted = frozenset(vocabulary)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(wanted.intersection(words_of(text or "")))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), "string"), "n": pa.array(list(seen.values()), "int64")})

    total = own_columns(docs, "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in total.collect()}


class TemplateIndex:
    """Prefix index of the templates under a global order of words."""

    def __init__(self, templates, frequency: dict[str, int], containment: float, named: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = NAMED):
        self.must = [frozenset(named.get(label, ((), ()))[0]) for label, _ in templates]
        self.never = [frozenset(named.get(label, ((), ()))[1]) for label, _ in templates]
        self.sets, self.least, self.width, self.prefix = [], [], [], defaultdict(list)
        for t, (_, text) in enumerate(templates):
            ordered = sorted(set(words_of(text)), key=lambda w: (frequency.get(w, 0), w))
            need = needed(len(ordered), containment)
            self.sets.append(frozenset(ordered))
            self.least.append(need)
            self.width.append(-(-len(words_of(text)) * 10**6 // round(containment * 10**6)))
            for i, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix[w].append((t, i))
        self.rare = frozenset(self.prefix)
        self.shortest = min(self.least, default=1)

    def matches(self, block: set[str]) -> list[tuple[int, int]]:
        """Template and overlap of each template that the block contains well enough."""
        if len(block) < self.shortest:
            return []
        first: dict[int, int] = {}
        for w in self.rare & block:
            for t, i in self.prefix[w]:
                first[t] = min(i, first.get(t, i))
        out = []
        for t, i in first.items():
            if len(block) >= self.least[t] and len(self.sets[t]) - i >= self.least[t]:
                if (overlap := len(self.sets[t] & block)) >= self.least[t]:
                    out.append((t, overlap))
        return sorted(out)

    def line(self, own: list[str]) -> list[tuple[int, int]]:
        """Template and overlap of each template that a line matches: as a whole, or by a window if it is longer than one."""
        whole, out = set(own), []
        for t, overlap in self.matches(whole):
            if len(own) <= self.width[t]:
                if self.must[t] <= whole and not self.never[t] & whole:
                    out.append((t, overlap))
            elif self.must[t] <= whole:
                blocks = (set(own[k : k + self.width[t]]) for k in range(len(own) - self.width[t] + 1))
                shares = [n for b in blocks if (n := len(self.sets[t] & b)) >= self.least[t] and self.must[t] <= b and not self.never[t] & b]
                if shares:
                    out.append((t, max(shares)))
        return out

    def windows(self, words: list[str], ends: list[int], alone: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Line, template and overlap of each window over several lines that matches; apart, the best of those that overlap.

        ends has the number of words up to the end of each line, alone the lines and templates that match already.
        """
        out = []
        whole = set(words)
        for t, _ in self.matches(whole):
            if not self.must[t] <= whole:
                continue
            own, width = self.sets[t], self.width[t]
            never = [i for i, w in enumerate(words) if w in self.never[t]] if self.never[t] & whole else []
            taken = sorted(line for line, other in alone if other == t)
            places = [(i, bisect_right(ends, i)) for i, w in enumerate(words) if w in own]
            places = [(i, line) for i, line in places if (line, t) not in alone]
            inside: Counter = Counter()
            low, passed, found = 0, 0, []
            for k, (last, line) in enumerate(places):
                if (before := bisect_right(taken, line)) != passed:
                    inside.clear()
                    low, passed = k, before
                inside[words[last]] += 1
                while last - places[low][0] >= width:
                    w = words[places[low][0]]
                    inside[w] -= 1
                    if not inside[w]:
                        del inside[w]
                    low += 1
                begin = places[low][0]
                if len(inside) >= self.least[t] and all(w in inside for w in self.must[t]) and bisect_right(never, last) == bisect_right(never, begin - 1):
                    found.append((places[low][0], last, places[low][1], len(inside)))
            k = 0
            while k < len(found):
                reach = found[k][0] + width
                best = found[k]
                while k < len(found) and found[k][1] < reach:
                    best = max(best, found[k], key=lambda x: x[3])
                    k += 1
                out.append((best[2], t, best[3]))
                while k < len(found) and found[k][0] <= best[1]:
                    k += 1
        return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT, named=NAMED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the matched blocks.

    blocks holds line (the first one), label and overlap as a share of the template's words; score is the best share, 1 where a phrase stands.
    """
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    index = TemplateIndex(templates, word_frequencies(docs, vocabulary), containment, named)
    split_phrases = [(p.split(), label) for p, label in phrases]
    kind = dict(docs.dtypes)["doc_id"]
    block_type = "array<struct<line:int,label:string,share:double>>"

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spaced = [(f" {' '.join(p)} ", p, label) for p, label in split_phrases]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        types = ["int64", "int64", "int64", "int64", "string", "string", "float64", pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("share", pa.float64())]))]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    n, places, base, blocks = 0, [], set(), []
                    words: list[str] = []
                    ends: list[int] = []
                    alone: set[tuple[int, int]] = set()
                    for number, line in enumerate((text or "").split("\n")):
                        own = words_of(line)
                        words += own
                        ends.append(len(words))
                        for t, overlap in index.line(own):
                            blocks.append({"line": number, "label": templates[t][0], "share": overlap / len(index.sets[t])})
                            alone.add((number, t))
                    wrapped = index.windows(words, ends, alone)
                    if wrapped:
                        blocks += [{"line": number, "label": templates[t][0], "share": overlap / len(index.sets[t])} for number, t, overlap in wrapped]
                        blocks.sort(key=lambda b: b["line"])
                    n = len(words)
                    joined = f" {' '.join(words)} "
                    for needle, phrase, label in spaced:
                        if needle in joined:
                            hits = [i for i in range(n - len(phrase) + 1) if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase]
                            places += hits
                            base.add(label)
                    score = 1.0 if places else max((b["share"] for b in blocks), default=0.0)
                    rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b["label"] for b in blocks})), score, blocks))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows), types))], ["doc_id", *names])

    return own_columns(docs, "doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks {block_type}")
