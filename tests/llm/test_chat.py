import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verbatlas.llm import chat

PIECES = st.lists(st.sampled_from(["\\", "### ", "</turn>", "</turn", ": ", ":", " ", "#", "###", "\n", "a", "é🙂", "Assistant", "{{ x }}", "{% endfor %}"]), max_size=12).map("".join)


def render(source, messages=(), **names):
    return "".join(t for t, _ in chat.compile_template(source)(messages, **names))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES), max_size=6))
def test_round_trip(turns):
    pieces = list(chat.compile_template(chat.TEMPLATE)([{"role": r, "text": t} for r, t in turns]))
    back = list(chat.read_turns(iter(pieces)))
    assert [(r, t) for r, t, _, _ in back] == turns
    assert [u for _, _, u, _ in back] == [t if r == "assistant" else "" for r, t in turns]
    assert sum(n for *_, n in back) == sum(len(t) for t, _ in pieces)
    # the same from the flat text, without the pieces' bounds
    flat = [("".join(t for t, _ in pieces), False)] if pieces else []
    assert [(r, t) for r, t, _, _ in chat.read_turns(iter(flat))] == turns


def test_language():
    msgs = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "yo"}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m['text'] | trim | upper }}{% if not loop.first %}!{% endif %}{% endfor %}", msgs) == "1HI2YO!"
    assert render("{% if a == 'x' %}1{% elif a == 'y' %}2{% elif a == 'z' %}3{% else %}4{% endif %}-", a="z") == "3-"
    assert render("{% if a == 'x' %}1{% elif a == 'y' %}2{% else %}4{% endif %}-", a="q") == "4-"
    assert render("{{ 'p' if b and not a else 'q' }}{{ 1 + 2 }}{{ 'a' ~ 1 }}{{ none }}{{ 'b' in 'abc' }}", a=False, b=True) == "p3a1True"
    assert render("{% set x = 'a' %}{{ x }}{% for m in messages %}{% set x = x ~ 'b' %}{% endfor %}{{ x }}", msgs) == "aabb"
    assert render("{{ \"q\\\"\\n\" }}") == 'q"\n'


def test_folding():
    body = chat.fold_body(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% set k = 'e' %}{{ k }}"), {}, set())
    assert body == [chat.Const("abcde")]


@pytest.mark.parametrize("bad", ["{{ f() }}", "{{ x.__class__() }}", "{% for x in %}{% endfor %}", "{% if a %}", "{% endif %}", "{{ }}", "{{ a | system }}", "{% import os %}", "{{ 'a }}", "{% for m in messages %}{% endif %}"])
def test_sandbox_rejects(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_sandbox_reaches_no_objects():
    assert render("{{ x.__class__ }}{{ x.y.z }}{{ messages.__len__ }}", [{}], x="s") == ""


def want(turns):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), h("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), h(loss)


def test_query_rows(spark):
    rows = [(1, 2, "assistant", "b</turn>\n### user: x"), (1, 1, "user", None), (1, 1, None, "a"), (2, None, "assistant", ""), (None, 0, "user", "n"), (3, 5, "assistant", "x" * 200_000)]
    rows += [(4, 0, "user", "same")] * 3 + [(5, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(500)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest_conversations(df).collect()}
    groups = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((r or "", x or ""))
    assert got == {c: want(turns) for c, turns in groups.items()}
    for r in chat.format_conversations(df).collect():
        assert [(a, b) for a, b, _, _ in chat.read_turns(iter([(r.formatted, False)]))] == groups[r.conv_id]
        under = "".join(chat.unescaped(r.formatted[s.start : s.end]) for s in r.spans)
        assert under == "".join(t for role, t in groups[r.conv_id] if role == "assistant")
    assert chat.digest_conversations(df.limit(0)).count() == 0


def test_added_conversation(spark):
    r = chat.op5_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()
    text = "\\### Assistant: </turn> ok"
    assert [tuple(x)[1:5] for x in r] == [want([("user", text), ("assistant", text)])]


def test_comments_trim_marks_and_quoted_ends():
    text = lambda t, **names: "".join(p for p, _ in chat.compile_template(t)([{"role": "u", "text": "a"}, {"role": "v", "text": "b"}], **names))
    assert text("x{# note }} %} #}y") == "xy"
    assert text("x \n{%- for m in messages -%}  {{- m.text -}} ;  {% endfor -%}  z") == "xa;  b;  z"
    assert text("{{ 'a }} b' }}|{% if '%}' == '%}' %}1{% endif %}") == "a }} b|1"
    assert text("{% for m in messages %}{% if m.role not in 'v' %}{{ m.text }}{% endif %}{% endfor %}") == "a"
    for bad in ("{% for m in messages %}{{ loop.last }}{% endfor %}", "{{ messages[0] }}", "{% for m in messages %}{{ loop['length'] }}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


@pytest.mark.parametrize("kind", ["short", "byte", "int", "string", "decimal(10,0)", "date"])
def test_ids_of_any_type(spark, kind):
    value = "2024-01-02" if kind == "date" else "7"
    rows = spark.createDataFrame([(value, 1, "user", "hi")], "conv_id string, turn long, role string, text string").selectExpr(f"cast(conv_id as {kind}) as conv_id", "turn", "role", "text")
    for out in (chat.format_conversations(rows), chat.digest_conversations(rows)):
        assert str(out.first().conv_id) == value
