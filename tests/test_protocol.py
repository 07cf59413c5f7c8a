"""Rendering and compilation: goldens worked out by hand, errors, and batch against single rows."""

import json

import pytest

from tessera.operators.compile import compile_one, compile_plans, compile_rows, halving
from tessera.operators.tokenizers import ByteTokenizer, IsolatedTokenizer, TokenizerFailure, TokenizerTimeout, TrieTokenizer, from_backend_json
from tessera.plans import render, template
from tessera.protocol import IGNORED, MARKERS, Invalid, check_ids

CHAT = [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}]
TOOLS = [{"type": "function", "function": {"name": "look", "parameters": {}}}]


def test_golden_text_and_counts():
    assert render.plan_text(render.plan(CHAT), "<eos>") == "<|usr|>\nhello\n<|eot|>\n<|out|>\nhi\n<|eot|>\n<eos>"
    ids, labels, mask = compile_one(ByteTokenizer(), [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}])
    assert len(ids) == 13 and sum(mask) == 7 and [x for x in labels if x != IGNORED] == [i for i, m in zip(ids, mask) if m]
    assert compile_one(ByteTokenizer(), [])[0] == [ByteTokenizer.eos]


def test_payload_never_becomes_structure():
    text = "".join(MARKERS.values())
    ids, _, _ = compile_one(ByteTokenizer(), [{"role": "user", "content": text}])
    assert sum(1 <= i <= 10 for i in ids) == 2 and bytes(i - 11 for i in ids[2 : 2 + len(text)]).decode() == text


def test_prompt_is_a_prefix_of_the_whole():
    for reply in ({"role": "assistant", "content": "hi"}, {"role": "assistant", "content": "", "tool_calls": [{"id": "1", "name": "look", "arguments": {}}]}):
        whole = render.plan_text(render.plan([CHAT[0], reply], TOOLS))
        assert whole.startswith(render.plan_text(render.plan(CHAT[:1], TOOLS, generation_prompt=True)))
    with pytest.raises(Invalid):
        render.plan(CHAT, generation_prompt=True)


def test_calls_and_observations():
    calls = [{"id": x, "type": "function", "function": {"name": "look", "arguments": {"b": 1, "a": "é"}}} for x in "xy"]
    m = [CHAT[0], {"role": "assistant", "tool_calls": calls}, {"role": "tool", "tool_call_id": "y", "content": {"z": 1, "a": None}}, {"role": "tool", "tool_call_id": "x", "content": "fine"}]
    text = render.plan_text(render.plan(m, TOOLS))
    assert '<|act|>\n{"arguments":{"a":"é","b":1},"id":"x","name":"look","type":"tool"}\n<|act|>' in text
    assert '<|obs|>\n{"caused_by":"y","content":{"a":null,"z":1}}\n<|obs|>\n{"caused_by":"x","content":"fine"}\n' in text


@pytest.mark.parametrize("messages, tools, options", [
    ([{"role": "alien", "content": "x"}], None, {}),
    ([CHAT[0], {"role": "assistant", "tool_calls": [{"id": "1", "name": "other", "arguments": {}}]}], TOOLS, {}),
    ([CHAT[0], {"role": "assistant", "tool_calls": [{"id": "1", "name": "look", "arguments": "{}"}]}], TOOLS, {}),
    ([CHAT[0], {"role": "assistant", "tool_calls": [{"id": "1", "name": "look"}, {"id": "1", "name": "look"}]}], TOOLS, {}),
    ([CHAT[0], {"role": "assistant", "tool_calls": [{"id": "1", "name": "look"}]}], None, {}),
    ([{"role": "tool", "tool_call_id": "none", "content": "x"}], TOOLS, {}),
    (CHAT, TOOLS, {"caps": {"tools": TOOLS}}),
    (CHAT, TOOLS * 2, {}),
    ([{"role": "user", "content": {"n": float("nan")}}], None, {}),
    ([{"role": "user", "content": [1]}], None, {}),
])
def test_errors(messages, tools, options):
    with pytest.raises(Invalid):
        render.plan(messages, tools, **options)


def test_thinking_options_and_blank_replies():
    m = [CHAT[0], {"role": "assistant", "reasoning_content": "why", "thinking": "no", "content": " \n"}]
    assert render.plan_text(render.plan(m)) == "<|usr|>\nhello\n<|eot|>\n<|think|>\nwhy\n<|eot|>\n"
    assert render.plan_text(render.plan(m, preserve_thinking=False)) == "<|usr|>\nhello\n<|eot|>\n<|eot|>\n"
    text = render.plan_text(render.plan(CHAT, ctrl={"b": 1, "a": 2}, caps="raw"))
    assert text.startswith('<|ctrl|>\n{"a":2,"b":1}\n<|caps|>\nraw\n<|usr|>')
    assert all(x != IGNORED for x in compile_one(ByteTokenizer(), CHAT, full_loss=True)[1])


def test_template_differs_where_it_should():
    text, spans = template.render(CHAT, eos="<eos>")
    assert text == render.plan_text(render.plan(CHAT), "<eos>") and "".join(text[a:b] for a, b in spans) == "<|out|>\nhi\n<|eot|>\n<eos>"
    assert template.render(CHAT, caps={"b": 1, "a": 2})[0].startswith('<|caps|>\n{"b": 1, "a": 2}\n')
    with pytest.raises(Invalid):
        template.render([{"role": "user", "content": 5}])


class Counting(ByteTokenizer):
    def __init__(self):
        self.seen = []

    def encode_batch(self, texts):
        self.seen += texts
        if "bad" in texts:
            raise TokenizerFailure("bad")
        return super().encode_batch(texts)


def test_batches_encode_each_text_once_and_isolate_failures():
    plans = [render.plan(CHAT) for _ in range(5)]
    t = Counting()
    assert compile_plans(plans, t) == [compile_one(ByteTokenizer(), CHAT)] * 5 and len(t.seen) == len(set(t.seen))
    found = halving([*plans, render.plan([{"role": "user", "content": "bad"}]), *plans], Counting())
    assert [x for x in found if isinstance(x, str)] == ["tokenizer_failure"] and len(found) == 11 and found[5] == "tokenizer_failure"


def test_longest_match_and_isolation():
    ids = {m: 10 + k for k, m in enumerate(MARKERS.values())}
    t = TrieTokenizer({"<unk>": 0, "a": 1, "ab": 2, "b": 3}, "<unk>", 4, ids)
    assert t.encode_batch(["abab", "ac", "", "ba"]) == [[2, 2], [0], [], [3, 1]]
    with pytest.raises(Invalid):
        check_ids({**ids, MARKERS["eot"]: 10})
    with pytest.raises(Invalid):
        from_backend_json(json.dumps({"model": {"type": "BPE"}}), 4, ids)
    apart = IsolatedTokenizer(ByteTokenizer, 20, ByteTokenizer.ids, 0, 267)
    assert apart.encode_batch(["a", "é"]) == ByteTokenizer().encode_batch(["a", "é"])
    apart.close()
    slow = IsolatedTokenizer(Sleepy, 0.3, ByteTokenizer.ids, 0, 267)
    with pytest.raises(TokenizerTimeout):
        slow.encode_batch(["a"])


class Sleepy(ByteTokenizer):
    def encode_batch(self, texts):
        import time

        time.sleep(30)


def test_rows_state_machine(spark):
    rows = [
        (1, json.dumps(CHAT), None), (2, json.dumps(CHAT[:1]), None), (3, "[1]", None), (4, json.dumps([CHAT[0], {"role": "assistant", "content": "x" * 99}]), None), (5, None, "invalid"), (6, "[]", None)]
    df = spark.createDataFrame([(i, m, "[]", r) for i, m, r in rows], "id int, messages_json string, tools_json string, rejection string")
    size = len(compile_one(ByteTokenizer(), CHAT)[0])
    got = {r.id: r.rejection for r in compile_rows(df, max_length=size).collect()}
    assert got == {1: None, 2: "no_target", 3: "invalid", 4: "too_long", 5: "invalid", 6: "no_target"}
    assert compile_rows(df.limit(0)).count() == 0
