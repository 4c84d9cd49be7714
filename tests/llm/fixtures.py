"""Small documents with nulls, empties, blanks, ties, copies, long texts and awkward characters."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string"


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    syllables = ["ba", "re", "ti", "ön", "ché", "lu", "mo", "sta", "中", "q's", "9", "#", "|"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda k: " ".join(word() for _ in range(k))
    passage, licence = sentence(70), "All Rights reserved by The Owners"
    out: list[tuple] = []
    for i in range(n):
        lines = [sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), ("  " if i % 2 else "\t") + (licence.upper() if i % 4 else licence) + " ")
        if i % 5 == 0:
            lines.append(passage)
        if i % 7 == 0:
            lines.append(lines[0])
        out.append((i, "\n".join(lines), "en", ["a", "b", "B", None][i % 4], 1, "x"))
    base = sentence(120)
    for k in range(12):  # near copies
        w = base.split(" ")
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = word()
        out.append((100 + k, " ".join(w), "en", "a", 1, "x"))
    out += [
        (200, None, None, None, None, None), (201, "", "en", "a", 0, None), (202, " \n\t\n ", "en", "b", 1, None), (203, "one", "en", "b", 3, None),
        (204, "Ab cd", "en", "c", 5, None), (205, "ab CD", "en", "c", 5, None), (206, out[0][1], "en", "a", 1, None), (206, out[0][1], "en", "a", 1, None),
        (207, "x " * 3000, "en", "a", 1, None), (208, "<|endoftext|>a  b \x1c c<|endo", "en", "d", 1, None), (None, "no id at all here", "en", "a", 1, None),
        (209, "z" * 450, "en", "a", 1, None), (210, passage * 30, "en", "a", 1, None),
    ]
    return out
