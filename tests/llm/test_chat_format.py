"""Chat formatting: the template language, and outputs read back."""

import hashlib
import random
from dataclasses import replace

import pytest

from spokewise.llm import chat_format as C
from spokewise.llm import queries
from spokewise.llm.template import Template, TemplateError
from tests.oracle import compare

ROW = "conv_id long, turn long, role string, text string, formatted string, piece int"
SAID = [r"\### Assistant: </turn> ok", "", "\\", "\\\\", "###", "####", "</turn>", "<</turn>>", r"\</turn>", "a: b", "\n### user: x</turn>\n", "é字𝒳\x00", "### "]


@pytest.mark.parametrize(
    ("source", "values", "want"),
    [
        ("a{{ x }}b", {"x": 1}, "a1b"),
        ("{{ x.y['z'] }}{{ x.nothing }}{{ nobody.at.all }}", {"x": {"y": {"z": "w"}}}, "w"),
        ("{{ l[0] }}{{ l[-1] }}{{ l[9] }}", {"l": ["a", "b"]}, "ab"),
        ("{% if a and not b or c %}1{% elif d == 'q' %}2{% else %}3{% endif %}", {"a": 0, "d": "q"}, "2"),
        ("{% if a is defined %}1{% else %}2{% endif %}{% if a is not defined %}3{% endif %}", {}, "23"),
        ("{% for x in l %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% else %}none{% endfor %}", {"l": ["a", "b"]}, "1a,2b"),
        ("{% for x in l %}{{ x }}{% else %}none{% endfor %}", {"l": []}, "none"),
        ("{% for x in l %}{% for y in x %}{{ y }}{% endfor %};{% endfor %}", {"l": [["a", "b"], ["c"]]}, "ab;c;"),
        ("a  {{- ' b ' | trim -}}  c{# no {{ x }} #}d", {}, "abcd"),
        ("{% set s = x ~ 1 + 2 %}{{ s }}", {"x": "n"}, None),
        ("{% set s = x ~ '1' ~ (1 + 2) %}{{ s | upper }}", {"x": "n"}, "N13"),
        ("{{ 'yes' if 'b' in 'abc' else 'no' }}{{ 2 - 3 }}{{ -1 }}{{ true }}{{ none }}", {}, "yes-1-1truenone"),
        (r"{{ 'a\n\'b' }}{{ x | replace('a', 'c') | default('z') }}{{ y | default('z') }}", {"x": "aa"}, "a\n'bccz"),
        ("{{ l | length }}{{ x }}", {"l": [1, 2], "x": 1.5}, "21.5"),
    ],
)
def test_language(source, values, want):
    if want is None:
        with pytest.raises(TemplateError):
            Template(source).render(**values)
    else:
        assert Template(source).render(**values)[0] == want


@pytest.mark.parametrize("bad", ["{{ a", "{% if a %}", "{{ a | nope }}", "{% for x l %}{% endfor %}", "{{ }}", "{{ a b }}", "{% end %}", "{% generation %}", "{{ f(1) }}", "{# x", "{{ 'a }}", "{% set for = 1 %}", "{{ a. }}"])
def test_unreadable(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def test_sandbox():
    class Thing:
        secret = "s"

    assert Template("{{ x.secret }}{{ x['secret'] }}{{ s.__class__ }}{{ s.upper }}").render(x=Thing(), s="a")[0] == ""
    for source in ("{% for x in s %}{% endfor %}", "{% for x in 3 %}{% endfor %}", "{{ nobody + 1 }}", "{{ none < 1 }}", "{{ 3 | length }}"):
        with pytest.raises(TemplateError):
            Template(source).render(s="text")


def test_constants_are_folded():
    assert Template("a{{ 'b' ~ 1 + 0 | default(2) }}".replace("1 + 0", "'1'")).tree == [("write", ("const", "ab1"))]
    assert Template("{% if 1 < 2 %}x{% else %}{{ y }}{% endif %}z").tree == [("write", ("const", "xz"))]
    assert Template("{{ o }}{{ y }}", constants={"o": "### "}).tree == [("write", ("const", "### ")), ("write", ("name", "y"))]
    assert Template("{{ false and y }}{{ y or 'a' }}{{ 'a' if y else 'b' ~ 'c' }}").tree[1:] == [("write", ("or", ("name", "y"), ("const", "a"))), ("write", ("pick", ("name", "y"), ("const", "a"), ("const", "bc")))]
    with pytest.raises(TemplateError):
        Template("{% set o = 1 %}", constants={"o": 2})


def test_generation_marks():
    text, spans = Template("a{% generation %}b{% generation %}c{% endgeneration %}d{% endgeneration %}e{% generation %}{% endgeneration %}").render()
    assert text == "abcde" and spans == [(1, 4), (5, 5)]


def test_streams():
    one = C.ChatFormat().compiled()
    assert one.streams("messages")
    assert not Template("{{ messages | length }}{% for m in messages %}{% endfor %}").streams("messages")
    assert not Template("{% for m in messages %}{% for k in messages %}{% endfor %}{% endfor %}").streams("messages")
    live = 0

    def stream():
        nonlocal live
        for i in range(1000):
            live = i
            yield {"role": "user", "text": "t"}

    pieces = C.rendered(one, stream(), 100)
    next(pieces)
    assert live < 20  # the rest is not read before the first piece leaves


def test_guard_round_trip():
    r = random.Random(1)
    chat = C.ChatFormat()
    for _ in range(2000):
        s = "".join(r.choices(["\\", "#", "###", "</turn>", "<", "/turn>", ":", " ", "a", "\n"], k=r.randrange(12)))
        assert chat.unguard(chat.guard(s)) == s and chat.unguard(chat.guard(s, ":")) == s


def brute(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = set()
    for c, own in by.items():
        own.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        out.add((c, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def talks():
    r = random.Random(2)
    rows = [(i, t, r.choice(["user", "assistant", "system", "to: ol", "###", ""]), r.choice(SAID) + r.choice(SAID)) for i in range(60) for t in range(r.randrange(1, 7))]
    return [*rows, (70, 1, None, None), (70, 0, "assistant", None), (70, None, "user", "first"), (None, 0, "user", "lost"), (None, 1, "assistant", "too"), rows[0], (71, 3, "user", "tie b"), (71, 3, "user", "tie a"), (72, 0, "assistant", "long é### " * 50_000)]


@pytest.mark.parametrize("piece", [C.PIECE, 1, 40])
def test_read_back(spark, piece):
    rows = talks()
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], ROW).repartition(4)
    out = C.format_conversations(df, piece=piece)
    assert {tuple(r)[:5] for r in C.chat_digest(out).collect()} == brute(rows)
    again = C.in_order(out)
    assert {tuple(r)[:5] for r in C.chat_digest(again).collect()} == brute(rows)
    turns = sorted(((r.conv_id is not None, r.conv_id or 0, r.role, r.text) for r in C.read_turns(again).collect()))
    assert turns == sorted((c is not None, c or 0, role or "", text or "") for c, _, role, text in rows)


def test_spans_and_size(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", "", 0), (1, 1, "assistant", "a### b", "", 0)], ROW)
    r = C.format_conversations(df).collect()[0]
    assert r.formatted == "### user: q</turn>\n### assistant: a\\### b</turn>\n" and r.learnt == [34, 41]
    assert r.formatted[34:41] == "a\\### b" and C.chat_digest(C.format_conversations(df)).first().formatted_chars == len(r.formatted)


def test_other_templates(spark):
    chat = C.ChatFormat("Talk of {{ messages | length }}\n" + C.TURNS + "{% generation %}bye{% endgeneration %}", mark="@@", end="<|end|>")
    rows = [(i, t, "assistant", s) for i in range(3) for t, s in enumerate([*SAID, "@@ x<|end|>"])]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], ROW)
    got = C.read_turns(C.format_conversations(df, chat), chat).collect()
    assert sorted((r.conv_id, r.pos, r.role, r.text) for r in got) == sorted(rows)
    assert C.format_conversations(df, replace(chat, template="nothing")).select("formatted").distinct().collect() == [("nothing",)]


def test_empty(spark):
    empty = spark.createDataFrame([], ROW)
    assert C.format_conversations(empty).collect() == [] and C.chat_digest(C.format_conversations(empty)).collect() == []


def test_query(spark, sf):
    assert compare(spark, queries.op13_chat_format, queries.OP13_SQL, sf)
    own = queries.op13_chat_format(spark, sf).where("conv_id = -7").first()
    said = r"\### Assistant: </turn> ok"
    assert own.n_turns == 2 and own.loss_chars == len(said) and own.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert own.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
