"""Texts that the tests of this folder share."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, row int"

#: Nulls, empty and very long texts, ties, repeated rows, odd characters, and columns whose names clash with the operators' own.
TEXTS = [
    (1, "The cat sat on the mat. The cat sat on the mat. The cat sat."),
    (2, "THE CAT SAT ON THE MAT. the cat sat on the mat. The cat sat."),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "word"),
    (None, "a text without an identifier, released under the MIT License. MIT license"),
    (8, "naïve café Ünïcode ▁ mark 日本語 😀 and spaces" + " " * 40 + "end"),
    (9, "x" * 5000),
    (10, " ".join(f"w{i}" for i in range(6000))),
    (11, " ".join(f"w{i}" for i in range(5990)) + " other tail"),
    (12, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 4785380592391139 end'),
    (12, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and 4785380592391139 end'),
    (14, "line one\nline two\nline one\nline one\n\n\n"),
    (15, "licensed under the Apache License, Version 2.0; GNU General Public License"),
    (16, "a\u0000b \x1f tab\tline\r\nnext"),
]


def rows_of(texts):
    return [(i, t, None if k % 3 == 0 else "en", [None, "b", "a", "é"][k % 4], len(t or ""), 0.5, "z", k) for k, (i, t) in enumerate(texts)]
