"""Header chunking against the recursion that it stands for."""

import re

import numpy as np

from docweave.operators import chunking


def parse(text):
    root = {"level": 0, "content": [], "children": [], "path": {}}
    stack, fenced = [root], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            stack[-1]["content"].append(line)
            continue
        m = None if fenced else re.match(r"^(#{1,6})\s+(.*)", line)
        if not m:
            stack[-1]["content"].append(line)
            continue
        level = len(m[1])
        while len(stack) > 1 and stack[-1]["level"] >= level:
            stack.pop()
        node = {"level": level, "content": [], "children": [], "path": stack[-1]["path"] | {level: m[2].strip()}}
        stack[-1]["children"].append(node)
        stack.append(node)
    return root


def prefix(node):
    return ["#" * k + " " + t for k, t in sorted(node["path"].items()) if t]


def rendered(node):
    out = prefix(node) + node["content"]
    for child in node["children"]:
        lines = rendered(child)
        out += lines
    return out


def cut(node, limit):
    if not node["children"]:
        return [(node, "\n".join(rendered(node)).strip())]
    own, out = "\n".join(node["content"]).strip(), []
    if own:
        out.append((node, "\n\n".join(prefix(node)) + "\n\n" + own))
    for child in node["children"]:
        text = "\n".join(rendered(child))
        out += [(child, text.strip())] if len(text) // 4 <= limit else cut(child, limit)
    return out


def test_header_chunks_are_those_of_the_recursion(spark):
    rng = np.random.default_rng(6)
    texts = [None, "", "short", "no heading " * 80, "# only a heading " * 40, "```\n# no heading\n```\n" + "word " * 200]
    for _ in range(40):
        lines = []
        for _ in range(int(rng.integers(1, 60))):
            if rng.random() < 0.4:
                lines.append("#" * int(rng.integers(1, 7)) + " " + str(rng.choice(["One", "Two two", "Three", ""])))
            elif rng.random() < 0.1:
                lines.append("")
            else:
                lines.append("some words " * int(rng.integers(1, 12)))
        texts.append("\n".join(lines))
    expected = {}
    for k, text in enumerate(texts):
        if text is None:
            continue
        parts = [({"path": {}}, text)] if len(text) // 4 <= 60 else cut(parse(text), 60)
        expected[k] = [([t for _, t in sorted(n["path"].items())], c) for n, c in parts if c.strip()]
    got = {}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in sorted(chunking.header_chunks(docs, 60).collect(), key=lambda r: (r["doc_id"], r["chunk_id"])):
        got.setdefault(r["doc_id"], []).append((r["path"], r["content"]))
    assert got == {k: v for k, v in expected.items() if v}
    assert chunking.header_chunks(docs.where("false")).count() == 0


def test_header_chunks_hold_few_texts_a_task(spark, monkeypatch):
    section = "\n".join(f"{'#' * (1 + k % 3)} Part {k}\n" + "some words " * (3 + k) for k in range(12))
    docs = spark.createDataFrame([(k, f"text {k}\n{section}" if k % 2 else f"short {k}") for k in range(60)] + [(None, section), (99, None)], "doc_id long, text string")
    rows = lambda found: sorted(map(str, found.collect()))
    whole = rows(chunking.header_chunks(docs, 60))
    monkeypatch.setattr(chunking, "TASK_CHARS", 2000)
    found = chunking.header_chunks(docs, 60)
    chars = sum(len(r["text"] or "") for r in docs.collect())
    assert found.rdd.getNumPartitions() == -(-chars // 2000) > spark.sparkContext.defaultParallelism
    assert rows(found) == whole and len({r["doc_id"] for r in found.collect()}) == 61
