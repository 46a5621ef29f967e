"""License notices: exact phrases, and fuzzy search of short notices by pigeonhole seeds and bounded-error matching.

A text is normalised to its words (A-Z lower-cased; runs of ASCII letters, digits and non-ASCII characters) joined by single spaces. A phrase is found
where its words stand consecutively. A notice allows ``errors`` character edits: cut into ``errors`` + 1 pieces, one piece of a true match must
stand unchanged (pigeonhole), so an Aho-Corasick automaton over all pieces locates candidates in one scan, and the regex library's
bounded-error matching verifies each candidate's own window (the notice's length and its edits) and reports the span and the number of edits, so time is linear in the text.

Defined cases: null text counts as empty (no words, no labels, score 0); every row has its own result, so doc_id may be null or repeated; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Phrases whose places count exactly, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices for the fuzzy search.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "creative commons attribution sharealike": "cc-by-sa",
    "released into the public domain": "public-domain",
}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Notices:
    """Exact phrases and fuzzy notices over normalised text. errors: character edits a notice may have, by its length: one for each ``per_error`` characters, ``most`` at most."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, per_error: int = 10, most: int = 4) -> None:
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), len(p.split()), label) for p, label in phrases.items()]
        self.automaton, self.patterns = ahocorasick.Automaton(), []
        seeds: dict[str, list[tuple[int, int, int]]] = {}
        for k, (notice, label) in enumerate(notices.items()):
            errors = max(1, min(most, len(notice) // per_error))
            self.patterns.append((regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}"), label, len(notice), errors))
            cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[a:b], []).append((k, a, b))
        for seed, places in seeds.items():
            self.automaton.add_word(seed, places)
        self.automaton.make_automaton()

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
        """(words, exact places as (first word, words, label), fuzzy spans as (first word, end word, label, similarity))."""
        tokens = words(text)
        joined = b" " + b" ".join(tokens) + b" "
        exact = []
        for phrase, n, label in self.phrases:
            at, counted, upto = joined.find(phrase), 0, 0
            while at >= 0:
                counted += joined.count(b" ", upto, at)
                upto = at
                exact.append((counted, n, label))
                at = joined.find(phrase, at + 1)
        return len(tokens), sorted(exact), self._fuzzy(joined.decode("utf-8", "surrogatepass")) if tokens else []

    def _fuzzy(self, joined: str) -> list[tuple[int, int, str, float]]:
        # A window is where the notice would lie if the seed is in place, moved by at most its edits; seeds of one notice mostly agree on it.
        windows: set[tuple[int, int, int]] = set()
        for end, places in self.automaton.iter(joined):
            for k, _, b in places:
                _, _, length, errors = self.patterns[k]
                windows.add((k, max(0, end + 1 - b - errors), min(len(joined), end + 1 - b + length + errors)))
        found, taken = [], {k: [] for k in range(len(self.patterns))}
        heap: list[tuple[int, int, int, int, int, int]] = []

        def look(k: int, start: int, stop: int) -> None:
            pattern, _, length, errors = self.patterns[k]
            if stop - start >= length - errors and (m := pattern.search(joined, start, stop)) and m.end() > m.start():
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), k, start, stop))

        for window in windows:
            look(*window)
        while heap:  # of matches that overlap the one with the fewest edits counts; what it leaves of the other's window is searched again
            edits, begin, end, k, start, stop = heapq.heappop(heap)
            spans, i = taken[k], bisect.bisect(taken[k], (begin, end))
            clash = next((s for s in spans[max(0, i - 1) : i + 1] if s[0] < end and begin < s[1]), None)
            if clash:
                look(k, start, min(stop, clash[0]))
                look(k, max(start, clash[1]), stop)
            else:
                spans.insert(i, (begin, end))
                found.append((begin, end, self.patterns[k][1], 1.0 - edits / self.patterns[k][2]))
        out, counted, upto = [], 0, 0
        for start, end, label, similarity in sorted(found):
            counted += joined.count(" ", upto, start + 1)
            upto = start + 1
            first = max(0, counted - 1)
            out.append((first, first + max(1, len(joined[start:end].split())), label, similarity))
        return out


def scan_notices(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """One row per document: ``doc_id, n_words, exact (array of first, words, label), fuzzy (array of first, end, label, similarity)``."""
    exact_type = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))
    fuzzy_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("similarity", pa.float64())]))
    made: list[Notices] = []

    def per_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Notices(phrases, notices))
        n, exact, fuzzy = [], [], []
        for t in batch.column(1).to_pylist():
            count, places, spans = made[0].search(t)
            n.append(count)
            exact.append([{"first": a, "words": w, "label": label} for a, w, label in places])
            fuzzy.append([{"first": a, "end": b, "label": label, "similarity": s} for a, b, label, s in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(exact, exact_type), pa.array(fuzzy, fuzzy_type)], ["doc_id", "n_words", "exact", "fuzzy"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, per_batch, "doc_id long, n_words long, exact array<struct<first:long,words:long,label:string>>, fuzzy array<struct<first:long,end:long,label:string,similarity:double>>")
