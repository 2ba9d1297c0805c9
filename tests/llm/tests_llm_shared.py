"""Brute force and rows that both test modules use."""

import random

from test_operators import brute_classes, brute_hits, prose

__all__ = ["brute_classes", "brute_hits", "documents_rows"]


def documents_rows():
    """(documents, labels, benchmark items): toxic words, near copies and leaked passages among plain rows."""
    r = random.Random(20)
    items = [(i, prose(r, 30, 3000)) for i in range(5)]
    rows, labels = [], []
    for i in range(260):
        words = prose(r, r.randrange(30, 90), 3000).split()
        toxic = i % 5 == 1
        for _ in range(2 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["wretch", "fiend", "swine"])
        if i % 17 == 0:
            words += items[i % 5][1].split()[3:20]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 60, 2) if i % 5 != 1] + [(2000 + i, rows[7][1]) for i in range(12)]
    return [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t)) for i, t in rows], labels, items
