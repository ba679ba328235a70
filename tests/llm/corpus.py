"""Small corpora with copies, near copies, shared passages and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(generator, n, vocabulary=400):
    return " ".join(f"w{int(generator.paretovariate(0.7)) % vocabulary}x" for _ in range(n))


def documents(seed=1, count=60):
    """(doc_id, text): unique texts, copies, near copies and passages pasted into other texts."""
    g = random.Random(seed)
    passage = sentence(g, 70)
    rows = []
    for i in range(count):
        lines = [sentence(g, g.randrange(3, 40)) for _ in range(g.randrange(1, 6))]
        if i % 5 == 1:
            at = g.randrange(len(lines))
            words = lines[at].split()
            cut = g.randrange(len(words))
            lines[at] = " ".join([*words[:cut], passage, *words[cut:]])
        rows.append([i, "\n".join(lines)])
    for k in range(count // 6):
        rows.append([count + 2 * k, rows[k * 3][1]])
        words = rows[k * 3][1].split(" ")
        words[g.randrange(len(words))] = f"edit{k}"
        rows.append([count + 2 * k + 1, " ".join(words)])
    return [tuple(r) for r in rows]


def odd():
    """Rows that operators must have an answer for."""
    return [(-1, None), (-2, ""), (-3, "   \n\n "), (-4, "x"), (None, "a text without an id, which is longer than five words"), (-5, "doubled row of text here now"), (-5, "doubled row of text here now"), (-6, "0123 !? ..."), (-7, "é漢字 😀   ß" * 40), (-8, "ab" * 4000), (-9, "a\0b \x1c c\r\nd")]


def frame(spark, rows):
    """documents with the given ids and texts, and further columns whose names clash with inner or other ones."""
    whole = [(i, t, "en" if (i or 0) % 2 else "de", "s", None, "other", 1, 2, [3], "z") for i, t in rows]
    return spark.createDataFrame(whole, SCHEMA + ", TEXT string, n long, h long, hits array<int>, key string")
