"""Style trees against plain Python: entropy, composite importance and pruning, without the parser."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_tree as h

SCHEMA = "page_id long, url string, html string"
STYLES = ["div.qa", "div.qb", "section.qc", "ul", "div", "table.qd", "p", "h2"]


def branch(g, depth, pool):
    """(style, text, children): its own text stands before its children."""
    style = g.choice(STYLES)
    if style in ("p", "h2"):
        return (style, g.choice(pool), ())
    text = g.choice([*pool, "", ""])
    children = tuple(branch(g, depth - 1, pool) for _ in range(g.randrange(0, 4))) if depth else ()
    return (style, text, children)


def sites(seed, pages=60):
    """(page_id, host, top level branches): hosts of different sizes that repeat branches and whole pages."""
    g = random.Random(seed)
    frames = [branch(g, 3, ["house rules", "about", "call us"]) for _ in range(6)]
    out = []
    for i in range(pages):
        host = "hot.example" if i % 3 else f"h{i % 5}.example"
        own = [branch(g, 2, [f"story {i} {k}" for k in range(3)]) for _ in range(g.randrange(1, 3))]
        out.append((i, host, (*g.sample(frames, 2), *own, frames[0])))
    out += [(pages + k, x[1], x[2]) for k, x in enumerate(out[:9])]
    return out


def render(branches):
    parts = []
    for style, text, children in branches:
        tag, _, name = style.partition(".")
        parts.append(f"<{tag} class={name}>" if name else f"<{tag}>")
        parts.append(text + render(children) + f"</{tag}>")
    return "".join(parts)


def trees(pages):
    """Composite importance of each (host, path)."""
    shapes, texts, below = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for host, top in {(x[1], x[2]) for x in pages}:
        shape, text = defaultdict(set), defaultdict(set)

        def visit(path, own, children, shape=shape, text=text, host=host):
            styles = [c[0] for c in children]
            shape[path].add(tuple(s for k, s in enumerate(styles) if not k or styles[k - 1] != s))
            if own:
                text[path].add(own)
            for c in children:
                below[host, path].add((*path, c[0]))
                visit((*path, c[0]), c[1], c[2])

        visit((), "", top)
        for path, found in shape.items():
            shapes[host, path].update(found)
        for path, found in text.items():
            texts[host, path].update(found)
    own, n = {}, {}
    for at, counter in shapes.items():
        n[at] = sum(counter.values())
        base = math.log(max(2, n[at]))
        if texts[at]:
            total = sum(texts[at].values())
            own[at] = max(0.0, 1 - sum(c * math.log(c) for c in texts[at].values()) / total / base)
        else:
            own[at] = -sum(c / n[at] * math.log(c / n[at]) for c in counter.values()) / base

    def value(host, path):
        if n[host, path] < 2:
            return 1.0
        inner = [value(host, c) for c in below[host, path]]
        if not inner:
            return own[host, path]
        weight = 0.9 ** (len(path) + 1)
        return (1 - weight) * own[host, path] + weight * sum(inner) / len(inner)

    return {at: value(*at) for at in shapes}


def best(host, branch, values, at):
    return max([values[host, at], *(best(host, c, values, (*at, c[0])) for c in branch[2])])


def pruned(host, branches, values, path=()):
    out = []
    for branch in branches:
        style, text, children = branch
        at = (*path, style)
        sure = style in ("p", "h2")
        if sure or best(host, branch, values, at) >= h.LOW:
            if text and (sure or values[host, at] >= h.LOW):
                out.append(text)
            out += pruned(host, children, values, at)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pruning(spark, seed):
    pages = sites(seed)
    values = trees(pages)
    rows = [(i, f"http://{host}/{i}", render(top)) for i, host, top in pages]
    got = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: " ".join(pruned(host, top, values)) for i, host, top in pages}
    assert any(got[i] != h.main_text(h.parse(source), {}) for i, _, source in rows)  # the tree decides


def test_levels_are_composite(spark):
    pages = sites(3)
    rows = spark.createDataFrame([(i, f"http://{host}/", render(top)) for i, host, top in pages], "n long, url string, html string")
    tree = h.style_tree(h.page_features(rows))
    whole = {(r["host"], r["path"]): r["value"] for r in h.composites(tree).collect()}
    hosts = defaultdict(list)
    for r in tree.collect():
        hosts[r["host"]].append(r.asDict())
    want = {(host, path): v for host, t in hosts.items() for path, v in h.composite(t).items()}
    assert whole == pytest.approx(want) and len(want) == tree.count()
    assert h.composites(tree, 2).count() == tree.where(F.col("depth") >= 2).count()


def test_deep_pages_are_pruned(spark):
    deep = "<div class=xa>Same words</div><div class=xb>" + "<div>" * 60 + "<div class=xa>Same words</div><div class=xc>Story {0}</div>"
    rows = [(i, "http://deep.example/", deep.format(i)) for i in range(6)]
    out = {r["page_id"]: r["text"] for r in h.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: f"Story {i}" for i in range(6)}
