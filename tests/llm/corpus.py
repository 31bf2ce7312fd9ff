"""A small corpus of awkward rows, and slow, plain versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import xxhash

SPACES = re.compile("[\x20\x09-\x0d]+")
PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall oak. "
    "Nobody in the village had seen such a thing before, and nobody wanted to miss it. "
    "The miller closed his shop early, the baker left the bread to cool on the sill. "
    "Even the old clock in the square seemed to tick a little slower that evening. "
)
SHARED = "This line is shared by several of the documents"

# Nulls, empty and blank texts, ties, repeated rows, a long text, odd characters.
ROWS = [
    (1, PROSE),
    (2, PROSE),
    (3, PROSE.replace("seven", "eight")),
    (4, f"{SHARED}\nown line of four\n  this LINE is shared by several of the documents \nshort"),
    (5, f"{SHARED}\r\nown line of five\nshort\n{SHARED}"),
    (6, ""),
    (7, None),
    (8, " \n\t \n"),
    (9, "one"),
    (10, "spam ### " * 80),
    (10, "spam ### " * 80),
    (None, PROSE),
    (None, f"{SHARED}\nanother"),
    (11, "É Ünïcode ÇA Va 日本語 " * 40 + "\n" + SHARED),
    (12, "word " * 30_000),
    (13, "\n".join(f"line number {n} of a long text" for n in range(3000))),
    (14, "\n".join(f"line number {n} of a long text" for n in range(0, 6000, 2))),
    (15, "a b c a b c a b d"),
]
SCHEMA = "doc_id long, text string"


def documents(spark, rows=ROWS):
    """The corpus with extra columns, some named like columns used inside operators."""
    wide = [(*row, "x", 1, 2, True, 3) for row in rows]
    return spark.createDataFrame(
        wide,
        f"{SCHEMA}, source string, doc long, mark long, kept boolean, n_dropped int",
    )


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def statistics(text):
    own, text = words(text), text or ""
    windows = Counter(tuple(own[n : n + 3]) for n in range(len(own) - 2))
    covered = {
        n + k for n in range(len(own) - 2) for k in range(3) if windows[tuple(own[n : n + 3])] > 1
    }
    lines = [line for line in text.split("\n") if words(line)]
    return (
        len(own),
        sum(map(len, own)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def fingerprint(text, width):
    own = words(lower(text or ""))
    if not own:
        return 0
    grams = [" ".join(own[n : n + width]) for n in range(max(1, len(own) - width + 1))]
    votes = [0] * 64
    for gram in grams:
        h = xxhash.xxh64_intdigest(gram.encode(), 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(grams))


def components(values, linked):
    """Index of the component of each value, by comparing every pair."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                parent[find(a)] = find(b)
    return [find(n) for n in range(len(values))]


def line_key(line):
    return lower(line.strip(" \t\n\x0b\f\r"))


def deduped_lines(rows):
    """``(n_lines, n_dropped, kept text)`` per row."""
    last = 1 << 63
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add(last if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = last if doc_id is None else doc_id
        kept = [
            line
            for line in lines
            if len(line_key(line)) < 10 or own == min(holders[line_key(line)])
        ]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out
