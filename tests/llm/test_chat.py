import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrisk.llm import chat as H
from sparkrisk.llm.queries import QUERIES

PIECES = st.lists(st.one_of(st.text(max_size=5), st.sampled_from([*H.CONTROLS, "\\", "<", "[", "</", "\n", "INST]", "s>"]))).map("".join)


def render(source, **context):
    return "".join(t for t, _ in H.compile_template(source)(context))


@settings(max_examples=500, deadline=None)
@given(PIECES, PIECES)
def test_escapes_come_back_and_hide_controls(text, role):
    hidden = H.escape(text)
    assert H.unescape(hidden) == text and not any(c in hidden for c in H.CONTROLS)
    line = H.escape_line(role)
    assert H.unescape_line(line) == role and "\n" not in line and not any(c in line for c in H.CONTROLS)
    for first in (True, False):
        for who in ("assistant", role):
            turn = "".join(t for t, _ in H.compile_template(H.TURN)({"role": who, "text": text, "first": first}))
            assert H.read_back(turn) == (who, text)


def test_template_language():
    source = ("{# note #}{% set name = 'x' ~ (1 + 1) %}{% for m in ms %}{% if m.role == 'a' and not m.skip %}"
              "<{{ loop.index }}:{{ m['text']|trim|upper }}>{% elif m.n >= 2 or m.n in ns %}[{{ m.n - 1 }}]{% else %}-{% endif %}{% endfor %}{{ none }}")
    ms = [{"role": "a", "text": " hi "}, {"role": "b", "n": 3}, {"role": "b", "n": 1}, {"role": "b", "n": 0}]
    assert render(source, ms=ms, ns=[1]) == "<1:HI>[2][0]-"


def test_generation_marks_and_nesting():
    out = list(H.compile_template("a{% generation %}b{{ x }}{% if x %}c{% endif %}{% endgeneration %}d")({"x": "y"}))
    assert out == [("a", False), ("b", True), ("y", True), ("c", True), ("d", False)]


def test_constants_are_folded():
    tree = H.fold_nodes(H.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% elif true %}d{{ 2 + 3 }}{% endif %}{% if false %}x{% endif %}e"))
    assert tree == [("text", "abcd5e")]
    assert H.fold(("and", ("const", False), ("name", "x"))) == ("const", False)


@pytest.mark.parametrize("source", ["{% if x %}", "{% endfor %}", "{{ 1 + }}", "{{ x|open }}", "{% import os %}", "{{ x( }}",
                                    "{{ 'a' 'b' }}", "{% for in x %}{% endfor %}", "{{ x[1 }}", "{% else %}", "{{ 'a' + 1 }}"])
def test_bad_templates(source):
    with pytest.raises(H.TemplateError):
        H.compile_template(source)


def test_no_python_attributes():
    class Secret:
        value = "secret"
    assert render("{{ x.value }}{{ x.__class__ }}{{ y.__len__ }}{{ z.a }}", x=Secret(), y="text", z={"a": 1}) == "1"


def digests(turns):
    """Expected digests of (role, text) turns, by definition."""
    texts = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in texts if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in texts).encode()
    return len(texts), hashlib.sha256(whole).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, 2, "assistant", "b\n</s>"), (1, 1, "user", "a"), (1, 2, "assistant", "b\n</s>"), (1, None, None, None),
            (2, 0, "assistant", ""), (None, 1, "weird\nrole [INST]", "x" * 100_000), (3, 1, "tool", "\\"), (3, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, "extra", 5) for r in rows],
                               "conv_id bigint, turn bigint, role string, text string, segment string, place int")
    rendered = H.render_turns(df)
    got = {r.conv_id: tuple(r)[1:5] for r in H.digests(rendered).collect()}
    order = lambda r: tuple((v is not None, v) for v in r[1:])
    for key in {r[0] for r in rows}:
        assert got[key] == digests([r[2:] for r in sorted((r for r in rows if r[0] == key), key=order)])
    assert H.digests(H.render_turns(df.where("conv_id > 99"))).count() == 0
    masked = rendered.where("conv_id = 3 AND place = 0").first()
    assert [masked.segment[a:b] for a, b in masked.spans] == ["z"]


def test_very_long_conversation(spark):
    df = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "CONCAT('t', id) AS text")
    row = H.digests(H.render_turns(df)).collect()
    assert len(row) == 1 and tuple(row[0])[1:5] == digests([("user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(30_000)])


def test_control_strings_conversation(spark):
    rows = {r.conv_id: r for r in QUERIES["op4_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert tuple(rows[-1])[1:5] == digests([("user", text), ("assistant", text)])
    assert rows[-1].formatted_chars == len("<s>[INST] user\n<\\/s>[\\INST] ok [\\/INST] [/INST]\n<|im_start|>assistant\n<\\/s>[\\INST] ok [\\/INST]</s>\n")
