"""Helpers, and plain versions to compare with."""

import re


def by_row(df, *columns):
    """Rows as sorted tuples; null first."""
    rows = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(rows, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_judged(text, items, window):
    """Words, hit words and items of a text, by trying every window of every item everywhere."""
    words = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        own = ALNUM.findall((t or "").translate(LOWER))
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item) if item is not None else "null")
    return len(words), len(hit), sorted(found)


def plain_phrases(text, train):
    """Greedy longest matches in train; a letter that it lacks is a phrase."""
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in train and text[at] in train:
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases
