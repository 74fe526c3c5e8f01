"""Tables with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
# Extra columns under names that the operators use inside.
EXTRA = ("row", "size", "key", "tie", "token", "tokens", "n", "place", "copy", "bucket", "taken", "target", "mark", "held", "all", "lead")


def with_extras(spark, rows, schema):
    names = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], f"{schema}, {names}")


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(words))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    base, other = prose(1, 300), prose(2, 120)
    changed = base.split()
    for k in (40, 150):
        changed[k] = "changed"
    passage = prose(3, 60)
    return [
        (1, base), (2, base), (3, " ".join(changed)), (4, base.upper()), (5, other), (6, f"{other} and a short end"), (7, None), (8, ""),
        (9, " \t\n\x0b\x0c\r "), (10, "one two three"), (11, "One  two\tTHREE"), (12, "one two three four"), (13, f"{prose(4, 80)} {passage} {prose(5, 80)}"),
        (14, f"{passage}\n{prose(6, 90)}"), (15, f"{prose(7, 50)} {passage}"), (16, "a" * 3000), (17, "ab" * 1700 + "c"), (18, "é漢字👍🏽 " * 60), (19, "É漢字👍🏽 " * 60),
        (20, prose(8, 60_000)), (21, "x" * 200_000), (22, f"{prose(8, 60_000)} tail"), (None, base), (None, "nobody's words are here at all"), (23, other), (23, other),
        (24, passage[:99]), (25, passage[:100]), (26, passage + passage), (27, "\x00 \x01 nul bytes \x00 in a text \x00"),
    ]


def word_list(text):
    return WORDS.findall((text or "").translate(LOW))


def shingles(text, width=5):
    words = word_list(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def jaccard_brute(rows, percent=75):
    """(id, set size) rows and the component of each id."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is None or j is None or not s or not t:
                continue
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def passages_brute(rows, length=100):
    """n_bytes, n_removed, n_spans and the digest of what stays, per (id, text)."""
    key = lambda r: (2**63 - 1 if r[0] is None else r[0], int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16))
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=key):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            piece = raw[p : p + length]
            if piece in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(piece)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[(i, text or "")] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def counted(rows):
    return collections.Counter(tuple(r) for r in rows)
