from lakewright.llm import chat

from .fixtures import clashing, empty

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    out = []
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        for person in sorted({r[2] or "unknown" for r in turns} - {"system"}):
            start = 0
            for position, (_, turn, role, text) in enumerate(turns):
                role, text = role or "unknown", text or ""
                name = "assistant" if role == person else "system" if role == "system" else f"user name={role}"
                head = f"<|im_start|>{name}\n"
                whole = head + text + "<|im_end|>\n"
                span = (start + len(head), start + len(whole) - 1) if role == person else (None, None)
                out.append((conv, person, position, turn, role, whole, start, len(whole), *span))
                start += len(whole)
    return out


def test_rotation(spark):
    rows = [(1, k, ["ann", "bob", "cy", "system"][k % 4], f"text {k} é日") for k in range(300)]
    rows += [(2, 5, "a", "x"), (2, 5, "a", "x"), (2, 5, "b", None), (2, None, None, "t"), (2, -70, "a", ""), (None, 1, "u", "v"), (3, 0, "system", "only"), (4, 2**40, "z", "l" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, chat.rotate(df).collect()), key=repr) == sorted(brute(rows), key=repr)
    assert sorted(map(tuple, chat.rotate(clashing(df)).collect()), key=repr) == sorted(brute(rows), key=repr)
    assert chat.rotate(empty(spark, SCHEMA)).count() == 0


def test_no_python(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")], SCHEMA)
    plan = chat.rotate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
