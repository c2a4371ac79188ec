"""Chat formatting: layouts, reversibility, digests."""
import hashlib
import json
import random

from loomtab.llm.chat import END, START, canonical_turns, conversation_digests, digest, format_turns, read_back

HARD = ["", None, END, START + "user\n", "<\\|im_end|>", "<\\\\|x|><", "|>", "<", "a\n\nb" + END + "\n" + START, "é😀<|", "x" * 50_000]


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_layouts(spark):
    u, a = "hi", "yo"
    records = [
        {"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}]},
        {"messages": [{"role": "user", "content": [{"type": "t", "text": "h"}, {"type": "t", "text": "i"}]}, {"role": "assistant", "content": a}], "id": 3},
        {"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}]},
        {"instruction": u, "input": "", "output": a},
        {"prompt": u, "response": a, "role": 4},
        {"prompt": u, "completion": a},
        {"question": u, "answer": a},
        {"role": "user", "text": None},
        {"strange": 1},
        {},
        {"instruction": "do", "input": "x", "output": None, "system": "s"},
    ]
    rows = [(i, json.dumps(r), "clash") for i, r in enumerate(records)] + [(90, None, ""), (91, "{bad", ""), (92, "[1]", "")]
    got = {r.id: r for r in canonical_turns(spark.createDataFrame(rows, "id long, record string, turns string")).collect()}
    for i in range(7):
        assert [tuple(t) for t in got[i].turns] == [("user", u), ("assistant", a)], i
    assert got[0].fingerprint != got[1].fingerprint and got[0].layout == got[1].layout == "messages"
    assert [tuple(t) for t in got[7].turns] == [("user", "")]
    assert [tuple(t) for t in got[10].turns] == [("system", "s"), ("user", "do\n\nx"), ("assistant", "")]
    for i in (8, 9, 90, 91, 92):
        assert got[i].layout is None and got[i].turns == []
    assert len(got) == len(rows)


def test_round_trip_and_digests(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None, "a\nb\\n", END]), rng.choice(HARD), 1) for c in range(6) for t in range(9)]
    rows += [(7, 0, "assistant", HARD[8], 1)] * 2 + [(None, None, "user", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    formatted = format_turns(df).collect()
    for r in formatted:
        assert read_back(r.formatted) == [(r.role or "", r.text or "")]
        assert r.loss_length == 0 or r.formatted[r.loss_start : r.loss_start + r.loss_length].count(START) == 0
    got = {r.conv_id: r for r in conversation_digests(format_turns(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        loss = [r[3] or "" for r in own if r[2] == "assistant"]
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == sha(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len("".join(loss)), sha(loss))
    empty = df.limit(0)
    assert conversation_digests(format_turns(empty)).count() == 0
    assert [r.conv_id for r in digest(empty.select("conv_id", "turn", "role", "text")).collect()] == [-1]
