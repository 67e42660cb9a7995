import hashlib
import random

import duckdb
import pytest

from lumigrid.llm import chat

DATA = "/root/testdata/sf0.001"
HOSTILE = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "[\\INST]", "<<SYS>>\n<</SYS>>", "", " ", "é[TURN][/TURN]\\", "<<</SYS>>>", "[ROLE] x [TURN] y", "", "[/INST", " [/INST]"]


def conversation(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "", "[TURN]"]), "".join(rng.choices(HOSTILE, k=rng.randint(0, 3)))) for _ in range(n)]


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices([*HOSTILE, *"<>[]/\\sINTSYROUE"], k=rng.randint(0, 12)))
        made = chat.escape(text)
        assert chat.unescape(made) == text
        assert not any(c in made for c in chat.CONTROL)


def test_turns_and_spans_of_random_conversations():
    rng = random.Random(5)
    for n in [0, 1, 2, 7, 30]:
        for _ in range(20):
            turns = conversation(rng, n)
            output, found, rewritten = chat.spans(turns, chat.instruct, frozenset({"assistant"}))
            assert chat.read_turns(output) == turns and rewritten is None
            assert "".join(output[s.start : s.end] for s in found) == output
            for (role, text), s in zip(turns, found):
                assert chat.unescape(output[s.text_start : s.text_end]) == (text if role == "assistant" else "")


def test_rewriting_templates_are_detected():
    def latest_system_first(turns):  # moves a late system turn to the front
        return "".join(t for r, t in turns if r == "system") + "".join(f"{r}:{t}\n" for r, t in turns if r != "system")

    def last_answer_only(turns):  # drops earlier answers
        return "".join(f"{r}:{t}\n" for k, (r, t) in enumerate(turns) if r != "assistant" or k == len(turns) - 1)

    turns = [("system", "S"), ("user", "a"), ("assistant", "b"), ("system", "T"), ("assistant", "c")]
    _, found, at = chat.spans(turns, latest_system_first, frozenset({"assistant"}))
    assert at == 3 and [s is None for s in found] == [False, True, True, True, True]  # the front stands, the rest moved
    _, found, at = chat.spans(turns, last_answer_only, frozenset({"assistant"}))
    assert at == 3 and [s is None for s in found] == [False, False, True, True, True]


def test_template_that_alters_a_text_gives_no_span():
    dropped = lambda turns: "".join(f"<{r}>{'' if 'secret' in t else t}</{r}>" for r, t in turns)
    output, found, at = chat.spans([("assistant", "a secret"), ("assistant", "b")], dropped, frozenset({"assistant"}))
    assert at is None and output[found[1].text_start : found[1].text_end] == "b"
    stripped = lambda turns: "".join(f"{r}: {t.strip()}" for r, t in turns)
    _, found, _ = chat.spans([("assistant", "x")], stripped, frozenset({"assistant"}))
    assert (found[0].text_start, found[0].text_end) == (11, 12)


def brute(rows):
    by = {}
    for conv_id, turn, role, text in rows:
        by.setdefault(conv_id, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv_id, own in by.items():
        turns = [(r, t) for _, _, _, r, _, t in sorted(own)]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
        out[conv_id] = (len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.instruct(turns)))
    return out


def test_operator_on_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 200_000), (1, 1, "assistant", "x" * 200_000), (2, None, None, "é"), (2, 5, "assistant", ""), (None, 0, "assistant", "no id"), (None, 1, "user", "u"), (3, 0, "user", "tie b"), (3, 0, "user", "tie a")]
    rows += [(9, k, "user" if k % 2 else "assistant", f"long {k}") for k in range(300)]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], "conv_id long, turn long, role string, text string, formatted string, spans int").repartition(5)
    made = chat.format_conversations(frame)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(made).collect()}
    assert got == brute(rows)
    assert all(r.rewritten_at is None and len(r.spans) == r.n_turns for r in made.collect())
    assert chat.read_back(chat.format_conversations(frame.where("false"))).collect() == []


def test_query_matches_sql(spark):
    got = chat.op11_chat(spark, DATA)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    want = con.sql(chat.ORACLE_SQL)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert next(r for r in got.collect() if r.conv_id == -7).loss_chars == len("</s>[INST] ok [/INST]")


@pytest.mark.parametrize("text", ["no turn", "<s>[INST] open"])
def test_other_strings_are_errors(text):
    with pytest.raises(ValueError):
        chat.read_turns(text)
