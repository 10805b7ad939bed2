"""License scans: short notices found with a bounded number of edits.

Texts and notices are compared as their words (letters A-Z lower-cased, ASCII
letters, digits and everything beyond ASCII) joined by one space.  A notice of n
characters may differ by ``n // CHARS_PER_EDIT`` edits (k).

1. *Seeds* (pigeonhole): a notice is cut into k + ``INTACT`` pieces.  Of an occurrence
   with at most k edits at least ``INTACT`` pieces are intact, and one Aho-Corasick
   pass over the text for all pieces of all notices meets them.
2. *Candidates*: a piece found at p that lies at o in its notice names the start p - o.
   Intact pieces of one occurrence differ by at most k in the start they name, so places
   where ``INTACT`` different pieces agree so far are kept, with k characters more at
   both ends; windows of a notice that overlap are joined.
3. *Verification*: the ``regex`` library's fuzzy matching searches the window with
   at most k insertions, deletions and substitutions; matches give their span, their
   edits and the notice's label.  Notices resemble each other, so a match gives way to
   an overlapping one of another label with fewer edits.

Besides, the places of three exact phrases are counted (``BASE``).  The score is that
of the best find: 1 for an exact phrase or notice, less by edits over length.

One narrow pass, no shuffle; memory is one text with its matches.

Defined cases: null or empty text has no words and no finds (score 0); very long
texts are searched whole; rows with the same or no id are separate rows; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

#: fixed values: phrases of the contract and common notices, as normalised words
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
)
CHARS_PER_EDIT = 10
#: pieces that must be found intact and in place before a window is verified
INTACT = 3
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + INTACT pieces of about equal length."""
    cuts = [len(notice) * i // (k + INTACT) for i in range(k + INTACT + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Finder:
    """Seeds and verifiers of a list of (label, notice)."""

    def __init__(self, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick
        import regex
        self.notices = [(label, text, len(text) // chars_per_edit) for label, text in notices]
        seeds = defaultdict(list)
        for i, (_, text, k) in enumerate(self.notices):
            for at, piece in pieces(text, k):
                seeds[piece].append((i, at))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        self.verify = [regex.compile("(?e)(?:%s){e<=%d}" % (regex.escape(text), k)) for _, text, k in self.notices]

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By notice: joined windows in which a match may lie."""
        found = defaultdict(list)
        for end, (size, uses) in self.seeds.iter(text):
            for i, at in uses:
                found[i].append((end + 1 - size - at, at))
        out = {}
        for i, named in found.items():
            if len(named) < INTACT:
                continue
            _, notice, k = self.notices[i]
            named.sort()
            joined, pieces_in, hi = [], Counter(), 0
            for lo, (start, at) in enumerate(named):
                while hi < len(named) and named[hi][0] <= start + k:
                    pieces_in[named[hi][1]] += 1
                    hi += 1
                if len(pieces_in) >= INTACT:
                    a, b = max(0, start - k), min(len(text), named[hi - 1][0] + len(notice) + k)
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(b, joined[-1][1])
                    else:
                        joined.append([a, b])
                pieces_in[at] -= 1
                if not pieces_in[at]:
                    del pieces_in[at]
            if joined:
                out[i] = joined
        return out

    def matches(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, length of the notice), by start, end and label."""
        out = []
        for i, spans in self.windows(text).items():
            label, notice, _ = self.notices[i]
            for lo, hi in spans:
                for m in self.verify[i].finditer(text, lo, hi):
                    out.append((label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice)))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def places(text: str, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand, in text with a space at both ends."""
    out, at, word, seen = [], text.find(f" {phrase} "), 0, 0
    while at >= 0:
        word += text.count(" ", seen, at)
        seen = at
        out.append(word)
        at = text.find(f" {phrase} ", at + 1)
    return out


def closest(found: list[tuple]) -> list[tuple]:
    """Matches that no overlapping match of another label undercuts in edits."""
    out, ahead, longest = [], 0, max((e - s for _, s, e, _, _ in found), default=0)
    for label, s, e, edits, n in found:
        while found[ahead][1] <= s - longest:  # starts ascend, no match is longer
            ahead += 1
        rivals = []
        for x in found[ahead:]:
            if x[1] >= e:
                break
            rivals.append(x)
        if not any(x[0] != label and x[2] > s and x[3] < edits for x in rivals):
            out.append((label, s, e, edits, n))
    return out


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
_FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
           ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
           ("spans", pa.list_(_SPAN))]


def scan(finder: Finder, text: str | None) -> tuple:
    """One text's row: see ``_FIELDS``."""
    w = words(text)
    flat = b" ".join(w).decode()
    padded = f" {flat} "
    base = {p: places(padded, p) for p in BASE}
    hits = sorted(x for at in base.values() for x in at)
    base_labels = {BASE[p] for p, at in base.items() if at}
    found = closest(finder.matches(flat))
    score = 1.0 if hits else max((1 - edits / n for _, _, _, edits, n in found), default=0.0)
    spans = [dict(label=label, first_word=flat.count(" ", 0, s + 1), last_word=flat.count(" ", 0, max(s, e - 1)), edits=edits)
             for label, s, e, edits, _ in found]
    return (len(w), len(hits), hits[0] if hits else None, hits[-1] if hits else None, sorted(base_labels),
            sorted(base_labels | {x[0] for x in found}), score, spans)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES,
                 chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``
    per row; spans are (label, first_word, last_word, edits) of the notices found."""
    d = docs.select(id_col, text_col)

    def run(batches):
        finder = Finder(notices, chars_per_edit)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = list(zip(*[scan(finder, t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, (_, t) in zip(rows, _FIELDS))],
                                                 names=["id", *(n for n, _ in _FIELDS)])

    schema = (f"id {d.dtypes[0][1]}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
              "labels array<string>, score double, "
              "spans array<struct<label: string, first_word: long, last_word: long, edits: long>>")
    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)
