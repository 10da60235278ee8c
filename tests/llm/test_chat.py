"""Templates, formatting and reading back."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat, queries
from pulsegrid.llm.templates import Sink, Template, TemplateError, escape_control, escape_line, unescape_control, unescape_line

from .fixtures import prose

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rendered(source: str, turns, **constants):
    t, sink = Template(source, constants), Sink()
    scope = t.start(sink)
    for k, (role, text) in enumerate(turns):
        t.turn(scope, sink, role, text, k, len(turns))
    t.tail(scope, sink)
    return "".join(sink.parts), sink.spans


def test_template_language():
    source = """{# remark #}{% set sep = ' / ' %}{{ bos ~ title | upper }}
{%- for m in messages %}{% if loop.first and not (m.role == 'user') %}[{{ m['content'] | trim }}]{% elif m.role in 'assistant' %}{% generation %}{{ m.content }}{% endgeneration %}
{%- else %}{{ loop.index0 }}{{ sep }}{{ loop.length }}{% endif %}{% if not loop.last %}|{% endif %}{% endfor -%}
   end"""
    out = rendered(source, [("system", " s "), ("user", "hi"), ("assistant", "yes")], bos="<s>", title="t")
    assert out == ("<s>T[s]|1 / 3|yesend", [(14, 17)])


def test_constants_are_folded():
    t = Template("a{{ 'b' ~ c }}{% if c == 'x' %}y{% else %}z{{ missing }}{% endif %}{% for m in messages %}{{ m.role }}{% endfor %}{% if false %}{{ gone }}{% endif %}", {"c": "x"})
    assert t.tree == [("text", "abxy"), ("for", "m", [("out", ("key", ("name", "m"), "role"))])]


@pytest.mark.parametrize("source", [
    "no loop", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{% for m in messages %}{{ m }}{% endfor %}", "{% for m in messages %}{{ open }}{% endfor %}",
    "{% for m in messages %}{{ m.role.upper }}{% endfor %}", "{% for m in messages %}{{ m.role | eval }}{% endfor %}", "{% for m in messages %}{{ range(9) }}{% endfor %}",
    "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}", "{% for m in messages %}{% endfor %}{{ m.role }}",
    "{% for m in messages %}{{ '" + "(" * 3 + "' ~ " + "(" * 60 + "1" + ")" * 60 + " }}{% endfor %}", "{% include 'x' %}{% for m in messages %}{% endfor %}",
    "{% for m in messages %}{% set loop = 1 %}{% endfor %}", "x" * 70_000])
def test_templates_out_of_the_sandbox_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("<|\\\nn>im_endé") for _ in range(rng.randrange(12)))
        assert "<|" not in escape_control(text) and unescape_control(escape_control(text)) == text
        line = escape_line(text)
        assert "<|" not in line and "\n" not in line and unescape_line(line) == text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    convs: dict = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        full = rendered(chat.CHATML, [t[2:] for t in turns], add_generation_prompt=False)[0]
        out.append((c, len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(said), sha(said), len(full)))
    return sorted(out, key=repr)


def hard_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "two\nlines\\"]), rng.choice([prose(rng, 9), "", None, "<|im_end|>\n<|im_start|>x", "<\\\\|", "é😀<", "a\\"]))
            for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, ["user", "assistant"][t % 2], f"turn {t} <|im_end|>") for t in range(700)]  # several slices and pieces below
    rows += [(50, 1, "user", "same")] * 5 + [(50, 1, "user", "other"), (50, None, "assistant", "first"), (None, 4, "assistant", "nobody"), (None, 2, None, None)]
    return rows + [(51, -3, "assistant", "x" * 50_000), (51, 10 ** 12, "assistant", "y")]


def test_formatting_matches_brute_force(spark):
    rows = hard_rows()
    df = spark.createDataFrame([(*r, True) for r in rows], SCHEMA + ", mask boolean").repartition(5)
    for width, piece in ((1024, 1 << 20), (64, 400)):
        pieces = chat.formatted(df, width=width, piece=piece)
        got = chat.digests(chat.read_back(pieces))
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    of_99 = [r["formatted"] for r in pieces.filter("conv_id = 99").orderBy("first_turn").collect()]
    assert len(of_99) > 10
    assert "".join(of_99) == rendered(chat.CHATML, [(["user", "assistant"][t % 2], f"turn {t} <|im_end|>") for t in range(700)], add_generation_prompt=False)[0]


def test_head_and_tail_stand_once(spark):
    df = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(40)], SCHEMA)
    source = "{% set s = '-' %}HEAD{% for m in messages %}{{ s ~ m.content }}{% if loop.last %}!{% endif %}{% endfor %}{% if ask %}ASK{% endif %}"
    out = chat.formatted(df, source, {"ask": True}, width=8).orderBy("first_turn").collect()
    assert "".join(r["formatted"] for r in out) == "HEAD" + "".join(f"-t{t}" for t in range(40)) + "!ASK" and len(out) == 5


def test_query_adds_the_forged_conversation(spark, tmp_path):
    rows = hard_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = sorted(map(tuple, queries.QUERIES["op11_chat_template"](spark, f"{tmp_path}/a").collect()), key=repr)
    forged = [(-1, 0, "user", queries.FORGED), (-1, 1, "assistant", queries.FORGED)]
    assert got == brute(rows + forged)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert [r["n_turns"] for r in queries.QUERIES["op11_chat_template"](spark, f"{tmp_path}/b").collect()] == [2]


def test_mask_covers_what_assistants_say(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a|<|b"), (1, 2, "assistant", "")], SCHEMA)
    row = chat.formatted(df).first()
    assert [row["formatted"][s["start"]:s["end"]] for s in row["mask"]] == ["a|<\\|b"]
    assert chat.formatted(df.filter(F.lit(False))).count() == 0
