import random

import tiktoken  # noqa: F401

from lakewright.llm import edits
from lakewright.llm.queries import vocabulary

from .fixtures import clashing, docs, empty

PATH = vocabulary("byte_bpe_50k.tiktoken")
PARTS = ["a", "B", " ", "  ", "\n", "'", "re", "'s", "1", "23", "é", "日本", "...", "\t", "ll", "\x85", "\x1c", "don't ", " x"]


def test_trees_follow_edits():
    counter, rnd = edits.Counter(PATH), random.Random(3)
    for k in range(800):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 900 if k % 10 == 0 else 60)))
        tree = edits.planted(text, counter)
        assert tree.total == len(counter.encode(text))
        for _ in range(6):
            place, removed = rnd.randint(-2, len(text) + 2), rnd.choice([0, 0, 1, 3, 20, 10_000])
            new = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 4)))
            at = max(0, min(place, len(text)))
            wanted = text[:at] + new + text[at + removed :]
            text, _ = edits.edited(text, tree, place, removed, new, counter)
            assert text == wanted and tree.total == len(counter.encode(text))
            assert edits.CountTree.unpacked(tree.packed()).total == tree.total


def test_long_text_is_hardly_read_again():
    counter = edits.Counter(PATH)
    text = "some words and more words, " * 20_000
    tree = edits.planted(text, counter)
    new, again = edits.edited(text, tree, 300_000, 4, "other", counter)
    assert again < 8 and tree.total == len(counter.encode(new))


def test_report(spark):
    df = docs(spark)
    rows = edits.report(clashing(df), PATH).collect()
    counter = edits.Counter(PATH)
    todo = df.withColumn("edits", edits.drawn_edits(df["doc_id"], df["text"])).collect()
    wanted = []
    for r in todo:
        text = r["text"] or ""
        before = len(counter.encode(text))
        for e in r["edits"]:
            at = min(e["place"], len(text))
            text = text[:at] + e["inserted"] + text[at + e["removed"] :]
        wanted.append((r["doc_id"], before, len(counter.encode(text))))
    assert sorted([(r["doc_id"], r["n_before"], r["n_tokens"]) for r in rows], key=repr) == sorted(wanted, key=repr)
    assert edits.report(empty(spark), PATH).count() == 0


def test_joined_edits(spark):
    state = edits.plant(spark.createDataFrame([(1, "ab cd"), (2, None), (3, "x")], "doc_id long, text string"), PATH)
    todo = spark.createDataFrame([(1, 1, 5, 0, " ef"), (1, 0, 0, 2, None), (2, 0, None, None, "new"), (9, 0, 0, 0, "z")], "doc_id long, seq int, place long, removed long, inserted string")
    found = {r["doc_id"]: r["text"] for r in edits.apply_edits(state, todo, PATH).collect()}
    assert found == {1: " cd ef", 2: "new", 3: "x"}
