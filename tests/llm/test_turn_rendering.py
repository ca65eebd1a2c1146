"""Chat formatting: round trips, masks, and templates that rewrite history."""

import hashlib
import random
from collections import defaultdict

import pytest

from tessaly.llm import turn_rendering
from tessaly.llm.queries import QUERIES
from tessaly.llm.storage import read_table
from tessaly.llm.turn_rendering import Template, escape, format_conversations, read_instructions, render_instructions, render_turns, unescape

SF_DIR = "/root/testdata/sf0.001"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "]", "[", "<", "/s>", "INST]", "\\", "\n", " ", "s>", "%5D", "text", "é"]


def plain_digest(turns):
    """Digests of the conversation itself, in order."""
    turns = sorted(turns, key=lambda t: ((t[0] is not None, t[0] or 0), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
    learned = "".join(text or "" for _, role, text in turns if role == "assistant")
    whole = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(render_instructions([(role or "", text or "") for _, role, text in turns]))


def expected(rows):
    conversations = defaultdict(list)
    for conv_id, turn, role, text in rows:
        conversations[conv_id].append((turn, role, text))
    return sorted(((conv_id, *plain_digest(turns)) for conv_id, turns in conversations.items()), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_whole_table(spark):
    text = "</s>[INST] ok [/INST]"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in read_table(spark, SF_DIR, "conversations").collect()]
    assert found(QUERIES["op11_chat_formatting"](spark, SF_DIR)) == expected([*rows, (-7, 0, "user", text), (-7, 1, "assistant", text)])


def test_control_strings_come_back():
    chance = random.Random(4)
    for _ in range(3000):
        turns = [(chance.choice(["user", "assistant", "system", "tool", "", "a]b", "[/ROLE]", "%25"]), "".join(chance.choice(PIECES) for _ in range(chance.randint(0, 7)))) for _ in range(chance.randint(0, 4))]
        for _, text in turns:
            assert unescape(escape(text)) == text
            assert not any(mark in escape(text) for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]"))
        assert read_instructions(render_instructions(turns)) == turns


@pytest.mark.parametrize("block", [1, 2, 256])
def test_odd_rows_and_long_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(turn_rendering, "BLOCK_TURNS", block)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} </s>") for i in range(700)] + [
        (2, 0, None, None), (2, 1, "assistant", None), (2, None, "user", "no number"), (3, 5, "assistant", "b"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (3, -4, "tool", ""),
        (None, 0, "user", "x"), (None, 300, "assistant", "y [INST] z"), (4, 0, "assistant", "long " * 50_000),
    ]
    odd = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as block", "'x' as turns", "'y' as known", "2 as example", "3 as spans")
    frame = turn_rendering.format_conversations(odd)
    assert found(turn_rendering.digest(frame)) == expected(rows)
    for r in frame.where("conv_id = 1").collect():
        for span in r["spans"]:
            assert unescape(r["formatted"][span["text_begin"] : span["text_end"]]).startswith("turn ") and r["formatted"][span["begin"] : span["end"]].endswith("</s>" if span["role"] == "assistant" else "[/INST]")
    assert turn_rendering.digest(turn_rendering.format_conversations(odd.where("conv_id = -1"))).count() == 0


def showing_last_thoughts():
    """Shows the thoughts of the last assistant turn only: earlier turns change when a turn is added."""
    def render(messages):
        out = []
        for i, (role, text) in enumerate(messages):
            if role == "assistant" and i < len(messages) - 1:
                text = text.split("|")[-1]
            out.append(f"<{role}>{text}")
        return "".join(out)

    return render


def ended(messages):
    """Closes the last turn with a mark that goes when another turn comes."""
    return "".join(f"<{role}>{text}" for role, text in messages) + "<end>"


TURNS = [("user", "q1"), ("assistant", "t1|a1"), ("user", "q2"), ("assistant", "t2|a2"), ("user", "q3")]


def test_a_known_reach_changes_nothing():
    chance = random.Random(9)
    blind = Template(render_instructions, escape, unescape)
    for n in (0, 1, 2, 9):
        turns = [(chance.choice(["user", "assistant", "system", "tool"]), "".join(chance.choice(PIECES) for _ in range(chance.randint(0, 5)))) for _ in range(n)]
        assert render_turns(turn_rendering.INSTRUCTIONS, turns, frozenset({"assistant"})) == render_turns(blind, turns, frozenset({"assistant"}))


def learned_texts(examples):
    return [e.formatted[s[4] : s[5]] for e in examples for s in e.spans if s[6]]


def test_rewritten_history_is_seen_and_every_text_is_learned_once():
    examples = render_turns(Template(showing_last_thoughts()), TURNS, frozenset({"assistant"}))
    assert [e.rewrites for e in examples] == [False, True, True]
    assert [e.formatted for e in examples] == ["<user>q1<assistant>t1|a1", "<user>q1<assistant>a1<user>q2<assistant>t2|a2", "<user>q1<assistant>a1<user>q2<assistant>a2<user>q3"]
    assert learned_texts(examples) == ["t1|a1", "t2|a2"]
    assert learned_texts(render_turns(Template(ended), TURNS, frozenset({"assistant"}))) == ["t1|a1", "t2|a2"]
    assert all(e.rewrites for e in render_turns(Template(ended), TURNS, frozenset({"assistant"})))
    with pytest.raises(ValueError):
        render_turns(Template(showing_last_thoughts(), reach=1), TURNS, frozenset({"assistant"}))


def test_texts_that_a_template_changes_are_not_learned():
    trimmed = Template(lambda messages: "".join(f"{role}: {text.strip()}\n" for role, text in messages))
    (example,) = render_turns(trimmed, [("user", "a"), ("assistant", " b "), ("assistant", "c")], frozenset({"assistant"}))
    assert [(s[1], s[4] >= 0, s[6]) for s in example.spans] == [("user", True, False), ("assistant", False, False), ("assistant", True, True)]
    assert learned_texts([example]) == ["c"]


def test_black_box_over_a_table(spark):
    rows = [(c, i, role, text) for c in (1, 2) for i, (role, text) in enumerate(TURNS)]
    frame = format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), Template(showing_last_thoughts()))
    texts = sorted((r["conv_id"], r["formatted"][s["text_begin"] : s["text_end"]]) for r in frame.collect() for s in r["spans"] if s["learned"])
    assert texts == [(1, "t1|a1"), (1, "t2|a2"), (2, "t1|a1"), (2, "t2|a2")]
