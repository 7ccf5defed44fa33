from __future__ import annotations

from gridrank.llm.chat_rotation import END, rotate

SCHEMA = "conv_id long, turn long, role string, text string, turns string, window int, speaker string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def brute(rows, window=64, system="system"):
    out = []
    key = lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        starts = {}
        for part in sorted({None if r[1] is None else r[1] // window for r in own}, key=lambda x: (x is None, x)):
            turns = sorted((r for r in own if (None if r[1] is None else r[1] // window) == part), key=lambda r: (key(r[1]), key(r[2]), (r[3] or "").replace("<|", "< |")))
            for speaker in {r[2] for r in own} - {None, system}:
                text, spans = "", []
                for _, _, role, said in turns:
                    text += "<|system|>" if role == system else "<|assistant|>" if role == speaker else f"<|user name={role or 'unknown'}|>"
                    body = (said or "").replace("<|", "< |") + END
                    if role == speaker:
                        spans.append(f"{len(text)}:{len(text) + len(body)}")
                    text += body
                out.append((conv, part, speaker, len(turns), starts.get(speaker, 0), text, ",".join(spans)))
                starts[speaker] = starts.get(speaker, 0) + len(text)
    return sorted(out, key=str)


def test_rotation_equals_brute_force(spark):
    rows = [(1, k, ["user", "assistant", "anna"][k % 3], f"é🙂 said {k}") for k in range(9)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", "hi <|end|>"), (2, 1, "user", "hi <|end|>"), (2, 2, "bob", None), (2, None, "bob", "late"), (2, 3, None, "who"), (2, 200, "user", "")]
    rows += [(3, 0, "system", "alone"), (None, 0, "user", "x"), (4, -1, "user", "before"), (5, 0, None, None)]
    found = sorted(map(tuple, rotate(table(spark, rows)).collect()), key=str)
    assert found == brute(rows)


def test_masks_cover_the_assistant_alone(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "world")]
    for r in rotate(table(spark, rows)).collect():
        said = [r.text[int(a) : int(b)] for a, b in (s.split(":") for s in r.mask.split(","))]
        assert said == [("hello" if r.speaker == "user" else "world") + END]


def test_parts_of_a_long_dialogue_make_one(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, ["user", "anna", None][k % 3], "é🙂" * (k % 5)) for k in range(1, 300)] + [(1, None, "anna", "late")]
    rows += [(None, k, "bob", "x") for k in range(130)] + [(2, 5, "bob", "short")]
    found = sorted(map(tuple, rotate(table(spark, rows)).collect()), key=str)
    assert found == brute(rows)
    whole = {(r[0], r[2]): r for r in brute(rows, window=10**9) if r[1] is not None}
    for (conv, speaker), one in whole.items():
        parts = sorted((r for r in found if r[0] == conv and r[2] == speaker), key=lambda r: r[4])
        text = "".join(r[5] for r in parts)
        spans = [(r[4] + int(a), r[4] + int(b)) for r in parts for a, b in (s.split(":") for s in r[6].split(",") if s)]
        assert text.startswith(one[5])
        assert all(text[a - len("<|assistant|>") : a] == "<|assistant|>" and text[a:b].endswith(END) for a, b in spans)


def test_empty_and_native(spark):
    df = rotate(table(spark, []))
    assert df.count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
