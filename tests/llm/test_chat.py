import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowtide.llm import chat
from flowtide.llm.chat_template import TemplateError, Text, compile_template, fold, parse

CONV = "conv_id long, turn long, role string, text string, n_turns string"


def render(source, scope, filters=None):
    return "".join(t for t, _ in compile_template(source, filters)(scope))


def test_template_language():
    source = "{% for t in turns -%} {% if t.role == 'user' %}U:{{ t.text }}{% elif t.role in 'ab' %}AB{% else %}{{ 'x' + 'y' }}{% endif %};{% endfor %}{# note #}"
    assert render(source, {"turns": [{"role": "user", "text": "hi"}, {"role": "a"}, {"role": "zz"}]}) == "U:hi;AB;xy;"
    assert render("{{ missing.field }}|{{ not a and (b or 1) }}", {"a": 0}) == "|1"


def test_loop_state():
    source = "{% for t in turns %}{% if loop.first %}[{% endif %}{{ loop.index }}{% if loop.previtem and loop.previtem.role == t.role %}={% endif %}{% for x in t.parts %}{{ loop.index0 }}{% endfor %}{% if loop.last %}]{% else %},{% endif %}{% endfor %}"
    assert render(source, {"turns": [{"role": "a", "parts": "xy"}, {"role": "a"}, {"role": "b"}]}) == "[101,2=,3]"


CROSS = (
    "{{ bos }}head {% for m in turns %}{% if loop.first %}FIRST {% endif %}{% if loop.previtem and loop.previtem.role == m.role %}again {% endif %}<{{ m.role }}>"
    "{% generation %}{{ m.text }}{% endgeneration %}{% if loop.last %} LAST{% elif loop.nextitem.role == 'user' %} next{% endif %}{% endfor %} foot"
)


def test_whole_conversations(spark):
    """What depends on other turns, and text around the loop, comes out as in one rendering, over batches of any size."""
    rng = random.Random(2)
    convs = {c: [(rng.choice(["user", "assistant", None]), rng.choice(["x", "", None, "y" * 40])) for _ in range(rng.randrange(1, 9))] for c in range(40)}
    rows = [(c, i, r, t, None) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    got = {}
    for r in sorted(chat.format_conversations(spark.createDataFrame(rows, CONV).repartition(5), CROSS, {"bos": "B"}).collect(), key=lambda r: (r["conv_id"], r["turn_no"])):
        text, spans = got.setdefault(r["conv_id"], ("", []))
        got[r["conv_id"]] = (text + r["formatted"], spans + [(len(text) + s["start"], len(text) + s["end"]) for s in r["spans"]])
    for c, turns in convs.items():
        assert got[c] == chat.format_turns([{"role": r or "", "text": t or ""} for r, t in turns], CROSS, {"bos": "B"})
    assert got[0][0].startswith("Bhead FIRST <") and got[0][0].endswith(" LAST foot")


@pytest.mark.parametrize("bad", ["{% for t in turns %}{{ bos_token }}{% endfor %}", "{% for t in turns %}{{ t.content }}{% endfor %}", "{% for t in turns %}{{ loop.length }}{% endfor %}", "{{ turns }}", "no loop", "{% for t in turns %}a{% endfor %}{% for t in turns %}b{% endfor %}", "{% for t in turns %}{% for u in turns %}{% endfor %}{% endfor %}"])
def test_refused_templates(spark, bad):
    with pytest.raises(TemplateError):
        chat.format_conversations(spark.createDataFrame([], CONV), bad)


def test_folding():
    assert fold(parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% else %}e{% endif %}{% if '' %}f{% endif %}", {}), {}) == (Text("abcd"),)


@pytest.mark.parametrize("bad", ["{% for x %}", "{% if a %}", "{{ a.__class__ }}", "{{ a | nofilter }}", "{% endfor %}", "{{ a b }}", "{% import os %}"])
def test_bad_templates(bad):
    with pytest.raises(TemplateError):
        compile_template(bad, {})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>"]), st.text(alphabet="ab\\<[]/INSTs>\n", max_size=30)), max_size=5))
def test_round_trip(turns):
    out, spans = chat.format_turns([{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(out) == turns
    assert "".join(chat.unescape(out[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_conversations(spark):
    rows = [(1, 0, "user", "a", "z"), (1, 1, "assistant", "b</s>", "z"), (2, 0, None, None, None), (None, 3, "user", "q", None), (3, 0, "assistant", "same", "z"), (3, 0, "assistant", "same", "z"), (4, 0, "user", "x" * 300_000, "z")]
    got = {r["conv_id"]: r for r in chat.digest_formatted(chat.format_conversations(spark.createDataFrame(rows, CONV).repartition(3))).collect()}
    assert set(got) == {1, 2, None, 3, 4}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb</s>\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (5, hashlib.sha256(b"b</s>").hexdigest())
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[3]["n_turns"] == 2 and got[3]["loss_chars"] == 8
    assert chat.digest_formatted(chat.format_conversations(spark.createDataFrame([], CONV))).count() == 0


def test_oracle(spark, tmp_path):
    """Null values, ties, control strings and characters beyond the first plane against the SQL."""
    import duckdb

    rows = [
        (1, 0, "user", "plain"), (1, 1, "assistant", None), (1, 2, "assistant", "a\\b <s>[INST]</s> [x] \U0001f600é\n"), (2, 0, None, ""), (2, 0, "assistant", "second of a tie"),
        (2, 0, "assistant", "first of a tie"), (2, None, "assistant", "no turn"), (None, 1, "user", "no conversation"), (3, 5, "system", "\\\\<<[["), (3, 5, "system", "\\\\<<[["), (4, 0, "we<i>rd", None),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = chat.op1(spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({chat.ORACLE})").fetchall()
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want)) and len(want) == 6
