"""Chat formatting: exact round trips, masks, escaping and the shape of the examples."""

import hashlib

import pytest

from usagepulse.llm import chat

T = chat.DEFAULT


def table_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def by_hand(rows):
    """Examples of one conversation, formatted with plain strings."""

    def escape(text):
        text = text.replace("\\", "\\\\")
        for c in T.controls:
            text = text.replace(c, c[0] + "\\" + c[1:])
        return text

    context, made = "", []
    for place, (role, text) in enumerate(rows):
        head = T.start + escape(role) + T.separator
        body = escape(text)
        if role == "assistant":
            made.append((context + head + body + T.end, len(context + head), len(body), place == len(rows) - 1))
        elif place == len(rows) - 1:
            made.append((context + head + body + T.end, 0, 0, True))
        context += head + body + T.end
    return made


TALK = [("system", "Be kind."), ("user", "Hi é\U0001f600"), ("assistant", "Hello."), ("user", ""), ("assistant", ""), ("user", "bye")]


def test_every_reply_is_an_example_with_all_before_it(spark):
    rows = [(1, n, r, t) for n, (r, t) in enumerate(TALK)]
    made = chat.format_examples(table_of(spark, rows)).orderBy("example").collect()
    assert [(r.formatted, r.loss_start, r.loss_chars, r.whole) for r in made] == by_hand(TALK)
    assert [r.example for r in made] == [0, 1, 2]


TRICKY = [
    "".join(T.controls), "<" + T.end, T.end[:-1], T.start[1:], "\\", "\\" + T.end, T.end + "\\", "<\\|im_end|>", "<\\\\|im_end|>",
    "<<|im_end|>|im_end|>", "</s>[INST] ok [/INST]", "a\nb\r\n\t", "$1 \\1 ${x}", "\x00\x1c", "<<SYS>><</SYS>>", "[[INST]]", "|>", "<|",
]


def test_control_strings_survive_in_texts_and_roles(spark):
    rows = [(n, k, role, text) for n, text in enumerate(TRICKY) for k, role in enumerate(["user", "assistant", text])]
    examples = chat.format_examples(table_of(spark, rows))
    assert rows_of(chat.read_turns(examples)) == sorted(rows)
    for formatted, turns in {(r.formatted, r.example + 2) for r in examples.where("example < 1").collect()}:
        assert formatted.count(T.start) == formatted.count(T.end) == formatted.count(T.separator) == turns
        assert not any(c in formatted for c in T.reserved)


def test_summary_equals_plain_digests(spark):
    talks = {1: TALK, 2: TALK[:3], 3: [("user", "only")], 4: [("assistant", T.end + "x"), ("assistant", "y")]}
    rows = [(c, n, r, t) for c, talk in talks.items() for n, (r, t) in enumerate(talk)]
    found = {r.conv_id: r for r in chat.summary(chat.format_examples(table_of(spark, rows))).collect()}
    assert found.keys() == talks.keys()
    for c, talk in talks.items():
        loss = "".join(t for r, t in talk if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for r, t in talk)
        assert found[c].n_turns == len(talk)
        assert found[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert found[c].formatted_chars == sum(len(e[0]) for e in by_hand(talk))
        assert found[c].n_examples == len(by_hand(talk))


def test_nulls_ties_repeats_and_clashing_names(spark):
    names = "conv_id long, turn long, role string, text string, said string, turns string, place int, formatted string, whole string, example int"
    rows = [(None, None, None, None), (None, 1, "assistant", "b"), (None, 1, "assistant", "a"), (5, 0, "user", "x"), (5, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "s", "t", 1, "f", "w", 2) for r in rows], names)
    examples = chat.format_examples(df)
    turns = sorted(((r.conv_id or 0, r.turn, r.role, r.text) for r in chat.read_turns(examples).collect()))
    assert turns == [(0, 0, "", ""), (0, 1, "assistant", "a"), (0, 2, "assistant", "b"), (5, 0, "user", "x"), (5, 1, "user", "x")]
    assert chat.summary(examples).count() == 2


def test_other_column_names_and_targets(spark):
    df = table_of(spark, [(1, 0, "bot", "a"), (1, 1, "user", "b")]).toDF("talk", "n", "who", "words")
    made = chat.format_examples(df, "talk", "n", "who", "words", targets=("user",))
    assert [(r.talk, r.example, r.whole, r.loss_chars) for r in made.collect()] == [(1, 0, True, 1)]
    assert chat.summary(made, "talk").collect()[0].loss_chars == 1


def test_empty_table(spark):
    none = table_of(spark, [])
    examples = chat.format_examples(none)
    assert examples.count() == chat.summary(examples).count() == chat.read_turns(examples).count() == 0


def test_long_texts_and_many_turns(spark):
    long = "word " * 400_000
    rows = [(1, n, "assistant" if n % 2 else "user", f"turn {n}") for n in range(801)] + [(2, 0, "assistant", long)]
    found = {r.conv_id: r for r in chat.summary(chat.format_examples(table_of(spark, rows))).collect()}
    assert (found[1].n_turns, found[1].n_examples) == (801, 401)
    assert found[2].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_plan_has_no_python_and_gathers_each_conversation_once(spark):
    plan = chat.summary(chat.format_examples(table_of(spark, [(1, 0, "user", "a")])))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert not any(x in text for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("controls", [dict(start="a\\b"), dict(start="<"), dict(reserved=("<|im_end|>x",)), dict(reserved=(">x<",))])
def test_control_strings_that_could_overlap_are_refused(controls):
    with pytest.raises(ValueError):
        chat.Template(**controls)
