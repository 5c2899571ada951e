import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from fringework.llm import chat


def model(rng):
    return chat.Model(np.array([rng.randrange(50) for _ in range(6)]), np.array([[rng.randrange(90) for _ in range(6)] for _ in range(6)]), np.array([[rng.randrange(90) for _ in range(chat.SEEN)] for _ in range(6)]))


def worth(m, seen, path):
    s = m.first[path[0]] + m.shows[path[0], seen[0]]
    return s + sum(m.step[a, b] + m.shows[b, x] for a, b, x in zip(path, path[1:], seen[1:]))


def test_best_path_by_brute_force():
    rng = random.Random(1)
    for _ in range(15):
        m = model(rng)
        seen = [rng.randrange(chat.SEEN) for _ in range(5)]
        best = max(worth(m, seen, p) for p in itertools.product(range(6), repeat=5))
        assert worth(m, seen, m.path(seen)) == best


def test_tables_of_parts_give_the_whole():
    rng = random.Random(2)
    for _ in range(20):
        m = model(rng)
        seen = [rng.randrange(chat.SEEN) for _ in range(30)]
        whole = m.forward(seen, m.first)[0]
        joined = (m.forward(seen[:11], m.first)[0][:, None] + m.table(seen[11:])).max(axis=0)
        assert (whole == joined).all()


def test_markers():
    for line, want in {"User: hi?": (1, "hi?"), "### Assistant: x": (2, "x"), "[system]: y": (0, "y"), "Human> z": (1, "z"), "**AI**: w": (2, "w"), "usery: no": (None, "usery: no"), "": (None, "")}.items():
        seen, rest = chat.observe(line)
        assert rest == want[1] and (seen // 6 == (0 if want[0] is None else want[0] + 1))


def test_roles_recovered(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    lines = chat.ordered(chat.transcript(turns), chat.shared_dir(spark))
    m = chat.fit(lines.where("conv_id % 2 = 0"))
    got = chat.parse(lines.where("conv_id % 2 = 1"), m).join(lines.select("conv_id", "place", "truth"), ["conv_id", "place"]).collect()
    right = sum(chat.STATES.index((chat.ROLES.index(r.role), r.begins)) == r.truth for r in got)
    assert right >= 0.95 * len(got)


def test_styles_that_the_model_has_not_seen(spark, monkeypatch):
    """Fitted on two styles and one set of names; judged on other conversations in other styles, with other names and twice as many bare turns."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    monkeypatch.setattr(chat, "STYLES", ("{}: ", "### {}: "))
    monkeypatch.setattr(chat, "SPOKEN", {"system": ("System",) * 2, "user": ("User",) * 2, "assistant": ("Assistant",) * 2})
    m = chat.fit(chat.ordered(chat.transcript(turns.where("conv_id % 2 = 0")), chat.shared_dir(spark)))
    monkeypatch.setattr(chat, "STYLES", ("[{}]: ", "{}> ", "**{}**: ", "<|{}|>: "))
    monkeypatch.setattr(chat, "SPOKEN", {"system": ("Instructions", "Sys"), "user": ("Human", "Q"), "assistant": ("Bot", "Answer")})
    lines = chat.ordered(chat.transcript(turns.where("conv_id % 2 = 1"), 5), chat.shared_dir(spark))
    got = chat.parse(lines, m).join(lines.select("conv_id", "place", "truth"), ["conv_id", "place"]).collect()
    assert sum(chat.ROLES.index(r.role) == r.truth // 2 for r in got) >= 0.9 * len(got)


def test_ties_go_to_the_lowest_state():
    """Nothing is known, so all paths that begin and go on as they may are worth the same."""
    m = chat.Model(np.zeros(6), np.zeros((6, 6)), np.zeros((6, chat.SEEN)))
    assert m.path([0, 5, 3]) == [0, 0, 0] and m.path([0, 0], enter=3) == m.path([0, 0], enter=3)


def test_counts_are_those_of_the_lines(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    lines = chat.ordered(chat.transcript(turns), chat.shared_dir(spark))
    first, step, shows = np.zeros(6), np.zeros((6, 6)), np.zeros((6, chat.SEEN))
    last = None
    for r in sorted(lines.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.place, r._row)):
        if r.truth is not None:
            shows[r.truth, chat.observe(r.line)[0]] += 1
            if last is None or last.conv_id != r.conv_id:
                first[r.truth] += chat.STATES[r.truth][1]
            elif last.part == r.part and last.truth is not None:
                step[last.truth, r.truth] += 1
        last = r
    want, got = chat.Model(first, step, shows), chat.fit(lines)
    assert (want.step == got.step).all() and (want.shows == got.shows).all() and (want.first == got.first).all()


def test_edges(spark):
    rows = [(1, 0, "user", "Hi\n\nthere"), (1, 1, "assistant", None), (1, 2, "tool", "x"), (1, 2, "tool", "x"), (None, 0, "user", ""), (2, None, None, "y" * 40000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("line", F.lit("clash"))
    got = chat.round_trip(turns).collect()
    assert len(got) == 8
    one = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.place))
    assert one.startswith("<|im_start|>user\nHi\n\nthere") and one.endswith("<|im_end|>\n") and one.count("<|im_start|>") == one.count("<|im_end|>")
    assert chat.round_trip(turns.limit(0)).count() == 0


def test_conversation_over_partitions(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"word {t}\nmore {'?' * (t % 3)}") for c in (1, 2, 3) for t in range(300 if c == 2 else 4)]
    turns = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = chat.ordered(chat.transcript(turns), chat.shared_dir(spark))
        assert lines.where("conv_id = 2").select("part").distinct().count() > 1
        m = chat.fit(lines)
        got = {(r.conv_id, r.place): r for r in chat.parse(lines, m).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    for c in (1, 2, 3):
        mine = sorted((r for r in lines.collect() if r.conv_id == c), key=lambda r: r.place)
        seen = [chat.observe(r.line)[0] for r in mine]
        want = m.path(seen)
        assert [chat.STATES.index((chat.ROLES.index(got[c, r.place].role), got[c, r.place].begins)) for r in mine] == want
        text = "".join(got[c, r.place].rendered for r in mine)
        assert text.count("<|im_start|>") == text.count("<|im_end|>")
