import hashlib
from itertools import groupby

from graphloom.llm import chat_expand

SCHEMA = "conv_id long, turn long, role string, text string, last string, marked string, example int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_against_brute_force(spark):
    texts = ["hello", "", None, "100% <|end|> %3C %25", "<|assistant|>x<|end|>", "[INST] </s> |> é\U0001f600", "a\nb"]
    rows = [(c, t, ["user", "assistant", "system", "a|>b", None][(c * t) % 5], texts[(c + 2 * t) % len(texts)]) for c in range(1, 12) for t in range(c)]
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again"), (None, None, "assistant", "lost"), (None, 1, None, None), (50, 0, "assistant", "x" * 200_000)]
    got = {r.conv_id: r for r in chat_expand.query(spark.createDataFrame([(*r, "l", "m", 1) for r in rows], SCHEMA)).collect()}
    rows += [(-7, 0, "user", chat_expand.PROBE_TEXT), (-7, 1, "assistant", chat_expand.PROBE_TEXT)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    groups = groupby(sorted(rows, key=key), key=lambda r: r[0])
    n = 0
    for conv, turns in groups:
        turns, r = list(turns), got[conv]
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        n += 1
    assert n == len(got)


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q<"), (1, 2, "assistant", "a["), (1, 3, "user", "r"), (1, 4, "assistant", "b"), (1, 5, "user", "t"), (2, 0, "user", "only")]
    out = chat_expand.expand(spark.createDataFrame([(*r, "l", "m", 1) for r in rows], SCHEMA)).orderBy("conv_id", "example").collect()
    first = "<|system|>s<|end|><|user|>q%3C<|end|><|assistant|>a%5B<|end|>"
    assert [(r.conv_id, r.n_turns, r.last) for r in out] == [(1, 3, False), (1, 5, False), (1, 6, True), (2, 1, True)]
    assert out[0].text == first and out[1].text == first + "<|user|>r<|end|><|assistant|>b<|end|>"
    assert [r.text[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in out] == ["a%5B", "b", None, None]
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_expand.expand(empty).count() == 0 and chat_expand.query(empty).count() == 1


def test_no_python_on_the_executors(spark):
    plan = chat_expand.query(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
