"""Transcripts parsed by a hidden Markov model, and rendered as canonical turns.

A line's hidden state is the role that speaks and whether the line begins a turn. What is seen of a
line is its speaker marker, if any, and a few features. The counts that the model is made of come
from labelled lines. Viterbi's best path is exact for conversations of any length: one that lies in
several partitions is first reduced to a table of best scores for each of its parts, from every
state to every state; the parts' border states follow from those, and then each part is decoded.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fringework.llm.common import shared_dir, stored

ROLES = ("system", "user", "assistant")
#: (role, whether it begins a turn)
STATES = tuple((r, b) for r in range(3) for b in (True, False))
N = len(STATES)
#: Names in speaker markers, and the role that they stand for.
NAMES = {
    "system": 0, "sys": 0, "instructions": 0,
    "user": 1, "human": 1, "question": 1, "q": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2, "model": 2,
}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?(" + "|".join(NAMES) + r")(?:\]|\|?>|\*\*)?\s*[:>\]]\s?", re.IGNORECASE)
#: Scores are whole thousandths of log-probabilities, so that sums are exact.
UNIT = 1000
#: Different observations: marker (none or one of three) x short, long or blank line x ends with a question mark.
SEEN = 4 * 3 * 2


def observe(line: str) -> tuple[int, str]:
    """(observation, the line without its marker)."""
    m = MARKER.match(line)
    rest = line[m.end() :] if m else line
    mark = NAMES[m[1].lower()] + 1 if m else 0
    size = 0 if not rest.strip() else 1 if len(rest) < 120 else 2
    return (mark * 3 + size) * 2 + rest.rstrip().endswith("?"), rest


class Model:
    """Scores of the first state, of each step and of what each state shows; from counts plus one."""

    def __init__(self, first: np.ndarray, step: np.ndarray, shows: np.ndarray):
        log = lambda n: np.round(UNIT * np.log((n + 1.0) / (n + 1.0).sum(axis=-1, keepdims=True))).astype(np.int64)
        allowed = np.array([[b2 or r1 == r2 for r2, b2 in STATES] for r1, _ in STATES])  # a turn goes on in its own role
        self.first = log(first)
        self.first[1::2] = -(10**9)  # a conversation's first line begins a turn
        self.step = np.where(allowed, log(step), -(10**9))
        self.shows = log(shows)

    def forward(self, seen: list[int], start: np.ndarray):
        """Best scores at the last line, and for each line which state before it was best (lowest of equals)."""
        back = np.empty((len(seen), N), np.int8)
        score = start
        for k, x in enumerate(seen):
            if k or start is not self.first:
                through = score[:, None] + self.step
                back[k] = through.argmax(axis=0)
                score = through.max(axis=0)
            score = score + self.shows[:, x]
        return score, back

    def table(self, seen: list[int]) -> np.ndarray:
        """Best scores from every state just before the lines to every state at their end."""
        best = self.step + self.shows[:, seen[0]]
        for x in seen[1:]:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + self.shows[:, x]
        return best

    def path(self, seen: list[int], enter: int | None = None, leave: int | None = None) -> list[int]:
        """The best states; enter is the state just before the lines, leave the last line's own."""
        start = self.first
        if enter is not None:
            start = np.full(N, -(10**12))
            start[enter] = 0
        score, back = self.forward(seen, start)
        state = int(score.argmax()) if leave is None else leave
        out = [state]
        for k in range(len(seen) - 1, 0, -1):
            state = int(back[k][state])
            out.append(state)
        return out[::-1]


def _observed(batches):
    """Adds what is seen of each line (seen) and the line before it in the same conversation and partition: whether there is one, and its truth."""
    last: tuple = ()
    for batch in batches:
        conv, lines = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        truth = batch.column(batch.schema.get_field_index("truth")).to_pylist() if "truth" in batch.schema.names else [None] * len(conv)
        goes_on, before = [], []
        for c, t in zip(conv, truth):
            goes_on.append(bool(last) and last[0] == c)
            before.append(last[1] if goes_on[-1] else None)
            last = (c, t)
        cols = [pa.array([observe(x or "")[0] for x in lines], pa.int32()), pa.array(goes_on, pa.bool_()), pa.array(before, pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "seen", "goes_on", "before"])


def ordered(lines: DataFrame, folder: str) -> DataFrame:
    """lines(conv_id, place, line, ...) in order, written down with the number of the partition that each row is in and what is seen of it."""
    first = ["conv_id", "place", "line"]
    out = lines.select(*first, *[F.col(c).cast("int") if c == "truth" else F.col(c) for c in lines.columns if c not in first])
    out = out.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("conv_id", "place", "_row").sortWithinPartitions("conv_id", "place", "_row")
    form = T.StructType([*out.schema.fields, T.StructField("seen", T.IntegerType()), T.StructField("goes_on", T.BooleanType()), T.StructField("before", T.IntegerType())])
    return stored(out.mapInArrow(_observed, form).withColumn("part", F.spark_partition_id()), folder, "lines")


def _by_part(df: DataFrame) -> DataFrame:
    """Rows of one part together and in order; parts are about a partition each."""
    return df.repartition("part").sortWithinPartitions("part", "conv_id", "place", "_row")


def _runs(batches, *cols):
    """(conv_id, part, rows) for consecutive rows of one conversation and part."""
    held, at = [], None
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "part", *cols))):
            if row[:2] != at and held:
                yield (*at, held)
                held = []
            at = row[:2]
            held.append(row[2:])
    if held:
        yield (*at, held)


def fit(lines: DataFrame) -> Model:
    """From ordered lines with column truth (a number of STATES, null where unknown): counts of all lines, summed where they lie.

    A few hundred numbers reach the driver. A line that goes on from another partition counts for what it shows only.
    """
    kinds = lines.where("truth is not null").groupBy("truth", "seen", "goes_on", "before").agg(F.count("*").alias("n"))
    first, step, shows = np.zeros(N), np.zeros((N, N)), np.zeros((N, SEEN))
    for r in kinds.collect():  # N * SEEN * 2 * (N + 1) rows at most
        shows[r.truth, r.seen] += r.n
        if r.before is not None:
            step[r.before, r.truth] += r.n
        elif not r.goes_on and STATES[r.truth][1]:
            first[r.truth] += r.n
    return Model(first, step, shows)


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, place, role, begins, text, rendered) for each of the ordered lines. Of paths of equal score the lowest state wins.

    The rendered pieces of a conversation, one after the other, are its canonical form:
    ``<|im_start|>role``, the turn's lines, ``<|im_end|>``. Rows of one place are ordered by where
    they stood in the input. Null lines count as empty; a null conv_id is a conversation of its own.
    """
    folder = shared_dir(lines.sparkSession)
    parts = stored(lines.groupBy("conv_id", "part").agg(F.count("*").alias("n")), folder, "parts")
    ends = stored(parts.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")), folder, "ends")
    # at most two conversations of a partition go on in another one
    cut = {(r.conv_id, r.part): (r.low, r.high) for r in parts.join(ends.where("low < high"), parts["conv_id"].eqNullSafe(ends["conv_id"])).select(parts["conv_id"], "part", "low", "high").collect()}

    def tables(batches):
        for conv, part, rows in _runs(batches, "line"):
            if (conv, part) in cut:
                seen = [observe(x or "")[0] for (x,) in rows]
                if cut[conv, part][0] == part:  # its first part: the same row for every state before
                    best = np.tile(model.forward(seen, model.first)[0], (N, 1))
                else:
                    best = model.table(seen)
                yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([best.ravel().tolist()], pa.list_(pa.int64()))], ["conv_id", "part", "best"])

    border: dict[tuple, tuple[int | None, int | None]] = {}
    if cut:
        spread = lines.join(F.broadcast(lines.sparkSession.createDataFrame(sorted({p for _, p in cut}), "int").toDF("part")), "part")
        found = {(r.conv_id, r.part): np.array(r.best).reshape(N, N) for r in _by_part(spread).mapInArrow(tables, "conv_id bigint, part int, best array<bigint>").collect()}
        for conv in {c for c, _ in cut}:
            mine = sorted(p for c, p in cut if c == conv)
            score, back = found[conv, mine[0]][0], []
            for p in mine[1:]:
                through = score[:, None] + found[conv, p]
                back.append(through.argmax(axis=0))
                score = through.max(axis=0)
            state = int(score.argmax())
            for p, b in zip(mine[:0:-1], back[::-1]):
                border[conv, p] = (int(b[state]), state)
                state = int(b[state])
            border[conv, mine[0]] = (None, state)

    def decode(batches):
        for conv, part, rows in _runs(batches, "line", "place"):
            seen = [observe(x or "") for x, _ in rows]
            states = model.path([x for x, _ in seen], *border.get((conv, part), (None, None)))
            low, high = cut.get((conv, part), (part, part))
            out = []
            for k, (s, (_, text)) in enumerate(zip(states, seen)):
                role, begins = STATES[s]
                head = ("" if k == 0 and part == low else "\n<|im_end|>\n") + f"<|im_start|>{ROLES[role]}\n" if begins else "\n"
                out.append((conv, rows[k][1], ROLES[role], begins, text, head + text + ("\n<|im_end|>\n" if k + 1 == len(rows) and part == high else "")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["conv_id", "place", "role", "begins", "text", "rendered"])

    return _by_part(lines).mapInArrow(decode, "conv_id bigint, place bigint, role string, begins boolean, text string, rendered string")


#: How the turns of a table are written down as a transcript; {} is the role's name.
STYLES = ("{}: ", "### {}: ", "[{}]: ", "{}> ", "**{}**: ")
SPOKEN = {"system": ("System", "Instructions"), "user": ("User", "Human"), "assistant": ("Assistant", "AI")}


def transcript(turns: DataFrame, bare: int = 10) -> DataFrame:
    """Lines (conv_id, place, line, truth) of turns(conv_id, turn, role, text); one turn in ``bare`` goes without a marker.

    place orders the lines. A role that is none of ROLES gives lines of unknown truth and no marker.
    """
    h = F.pmod(F.xxhash64("conv_id", "turn", F.lit(7)), F.lit(1 << 20))
    style = F.element_at(F.array(*map(F.lit, STYLES)), (F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))) + 1).cast("int"))
    name, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, r in enumerate(ROLES):
        two = F.when(F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(2)) == 0, SPOKEN[r][0]).otherwise(SPOKEN[r][1])
        name, number = F.when(F.col("role") == r, two).otherwise(name), F.when(F.col("role") == r, k).otherwise(number)
    marker = F.when((h % bare != 0) & name.isNotNull(), F.replace(style, F.lit("{}"), name)).otherwise("")
    d = turns.select(turns["conv_id"].cast("bigint").alias("conv_id"), turns["turn"].cast("bigint").alias("turn"), marker.alias("m"), number.alias("k"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "x"))
    return d.select(
        "conv_id", (F.coalesce("turn", F.lit(-1)) * (1 << 24) + F.col("i")).alias("place"),
        F.when(F.col("i") == 0, F.concat("m", "x")).otherwise(F.col("x")).alias("line"), (F.col("k") * 2 + (F.col("i") > 0).cast("int")).alias("truth"),
    )


def round_trip(turns: DataFrame) -> DataFrame:
    """Turns written down as transcripts, and what the model, fitted on the same table, makes of them."""
    lines = ordered(transcript(turns), shared_dir(turns.sparkSession))
    return parse(lines, fit(lines))
