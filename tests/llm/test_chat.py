import random

import pytest

from vidimus.llm import chat


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, {}).setdefault(-1 if turn is None else turn, set()).add((role or "", text or ""))
    seqs = {c: tuple(tuple(sorted(t[k])) for k in sorted(t)) for c, t in convs.items()}
    out = set()
    for c, s in seqs.items():
        if any((len(o) > len(s) and o[: len(s)] == s) or (o == s and d < c) for d, o in seqs.items()):
            continue
        at = 0
        for place, said in enumerate(s, 1):
            text = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in said)
            out.add((c, place, text, at, len(s)))
            at += len(text)
    return out


@pytest.mark.parametrize("span", [3, 1_000_000])
def test_maximal_conversations_are_rendered(spark, span):
    rnd = random.Random(1)
    rows = []
    for c in range(60):
        base = rnd.randrange(6)
        for t in range(rnd.randrange(1, 8)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"b{base} t{t}" if t < 5 else f"c{c} t{t}"))
    rows += [(100, 0, None, "x"), (100, 0, None, "x"), (100, None, "user", None), (101, 0, "user", "y"), (101, 0, "system", "z"), (None, 0, "user", "lost"), (102, 5, "user", "é" * 50_000), (103, 9, "user", "é" * 50_000), (103, 11, "user", "")]
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], "conv_id long, turn long, role string, text string, prefix string, place string").repartition(3)
    assert {tuple(r) for r in chat.format_chats(df, span).collect()} == plain(rows)
    assert chat.format_chats(df.limit(0)).count() == 0
