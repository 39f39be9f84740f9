import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from modelkeel.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, cost int, stop string"


def digests(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@given(st.text(alphabet="<|>\\\\[]/sINTlbpYend\n \U0001f600é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escape(text):
    written = chat.escape(text)
    assert chat.unescape(written) == text and not any(c in written for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))
    assert chat.parse(f"<|{chat.escape_role(text)}|>\n{written}<|end|>\n") == [(text, text)]


def test_windows(spark):
    rows = [(1, t, "system" if t == 0 else ["user", "assistant"][t % 2], f"t{t} " + "w " * (t * 7 % 40), 0, "") for t in range(700)]
    rows += [(2, 0, "user", chat.EXTRA, 0, ""), (2, 1, "assistant", chat.EXTRA, 0, ""), (3, 1, "assistant", "x " * 5000, 0, ""), (3, 2, "user", "after", 0, ""),
             (None, 1, "assistant", "a", 0, ""), (None, None, "assistant", None, 0, ""), (4, 1, None, "x|>\n", 0, ""),
             (5, 1, "assistant", "same", 0, ""), (5, 1, "assistant", "same", 0, ""), (6, 3, "a|>\nb", "", 0, "")]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=200, history=40, system=20).cache()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert got == digests(rows)
    mine = sorted((r.asDict() for r in windows.where("conv_id = 1").collect()), key=lambda r: r["window_no"])
    assert len(mine) > 50
    shown = 0
    for k, w in enumerate(mine):
        turns = chat.parse(w["formatted"])
        assert turns[0][0] == "system"
        assert sum(len(t.split()) + 4 for _, t in turns) <= 200
        if k:
            numbers = [int(t.split()[0][1:]) for _, t in turns[1:]]
            assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
            shown += w["n_context"] > 1
    assert shown > 40


def brute_windows(costs, budget, history, system, has_system):
    """Turn numbers (history, own) of each window, by the docstring."""
    step, starts = budget - history - system, [sum(costs[:i]) for i in range(len(costs))]
    cells = {}
    for i, (start, cost) in enumerate(zip(starts, costs)):
        cell = start // step
        cells.setdefault((cell, start + cost > (cell + 1) * step), []).append(i)
    out = []
    for own in (cells[k] for k in sorted(cells)):
        low, used = starts[own[0]], sum(costs[i] for i in own)
        room = min(history, budget - (costs[0] if has_system else 0) - used)
        past = [i for i in range(1 if has_system else 0, own[0]) if low - starts[i] <= room] if own[0] else []
        out.append((past, own))
    return out


def test_windows_keep_the_budget(spark):
    """Turns of 600, 900, 600, 900, 30, 900 tokens, and random ones, with and without a system turn of any length."""
    rng = random.Random(9)
    talks = {1: [600, 900, 600, 900, 30, 900], 2: [5000, 5, 5, 700]}
    talks |= {i: [rng.choice([5, 9, 60, 200, 640, 700, 1024]) for _ in range(rng.randint(1, 40))] for i in range(3, 40)}
    rows = [(c, t, "system" if t == 0 and c % 2 else "assistant", " ".join([f"n{t}", *["w"] * (cost - 5)]), 0, "")
            for c, costs in talks.items() for t, cost in enumerate(costs)]
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    for c, costs in talks.items():
        mine = sorted((r for r in windows if r["conv_id"] == c), key=lambda r: r["window_no"])
        got = []
        for k, w in enumerate(mine):
            turns = chat.parse(w["formatted"])
            numbers = [int(t.split()[0][1:]) for _, t in turns]
            held, own = numbers[: w["n_context"]], numbers[w["n_context"] :]
            if c % 2 and k:
                assert held[0] == 0
                held = held[1:]
            got.append((held, own))
            size = sum(costs[i] for i in numbers)
            assert size <= 1024 or len(own) == 1 and not held or c % 2 and costs[0] > 128 + 256
        assert got == brute_windows(costs, 1024, 256, 128, c % 2 == 1)


def test_no_rows(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], SCHEMA))).collect() == []
