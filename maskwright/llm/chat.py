"""Chat formatting: a hidden Markov model parses transcripts into turns and recovers their roles, which are then rendered
canonically.

A row of the table begins a turn, and its text may hold more of them. The model observes lines: a speaker marker
(``User:``, ``Q:``, ``### Assistant`` and the like, or none), the line's length, a closing question mark, whether it opens
the transcript, and, at a row's first line, the row's length and number of lines. A state is a role and whether the line begins a turn or goes on with one. Counts come from labelled
rows of all training conversations; as such rows seldom hold a transcript of several speakers, the tables of markers and
of turns that begin inside a row are mixed with a stated prior (``TRUST``, ``INSIDE``). All tables have a fixed size.
Viterbi finds the likeliest states.

A conversation may be long: rows are cut into blocks of ``BLOCK``, each block becomes a max-plus matrix of best scores
from any state before it to any state at its end, the matrices of one conversation are folded in order, and each block is
then solved again between its known ends. So a conversation's lines never meet in one task, only a matrix for each block.

Cases: null and empty texts are one empty line and render empty; repeated rows of a conversation and turn are separate
turns, ordered by text; null turns come first; a null conversation is a conversation of its own; without training rows
the prior alone decides, and ties go to the role that sorts first; marks inside a text are escaped, so that no text
forges a turn; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 1_024
ROLES = ("assistant", "system", "user")
N = len(ROLES)
#: States 0 to N - 1 begin a turn of that role, N to 2 N - 1 go on with one.
STATES = 2 * N
MARKERS = {
    "user": ("user", "human", "customer", "question", "q", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model"),
    "system": ("system", "instruction", "instructions", "context"),
}
_MARKER = r"^\s*(?:(?:<\|?|\[|\*{1,2})?\s*([A-Za-z]{1,12})\s*(?:\*{1,2}|\|?>|\])?\s*(?::\**|\|?>|\])|#{1,6}\s*([A-Za-z]{1,12})\s*:?\s*$)\s*"
LENGTHS = 12
LINES = 5
#: The last two tell of the whole row, at its first line; 0 stands at its others, and says nothing there.
FEATURES = {"marker": N + 1, "length": LENGTHS, "asks": 2, "first": 2, "row_length": LENGTHS + 1, "row_lines": LINES + 1}
#: How often a line that is not a row's first begins a turn, before it is seen.
INSIDE = 0.03
#: The prior's share in the table of markers: lines that begin a turn carry their own role's marker half of the time.
TRUST = 0.2
EVEN = 0.02


def _marker(line: Column) -> Column:
    """0, or 1 and the place of the role that a line's marker names."""
    word = F.lower(F.concat(F.regexp_extract(line, _MARKER, 1), F.regexp_extract(line, _MARKER, 2)))
    out = F.lit(0)
    for k, (_, names) in enumerate(sorted(MARKERS.items())):
        out = F.when(word.isin(*names), k + 1).otherwise(out)
    return out


def features(turns: DataFrame) -> DataFrame:
    """turns (conv, k, text, and whatever else) with lines, and obs, an array of feature values for each line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    bucket = lambda x: F.least(F.lit(LENGTHS - 1), F.floor(F.log2(F.length(x) + F.lit(1.0)))).cast("int")

    def observed(x: Column, i: Column) -> Column:
        whole = lambda v: F.when(i == 0, v + 1).otherwise(0)
        asks = x.rlike("[?¿][\\s\"')]*$").cast("int")
        return F.array(_marker(x).cast("int"), bucket(x), asks, ((F.col("k") == 0) & (i == 0)).cast("int"), whole(bucket(F.coalesce("text", F.lit("")))), whole(F.least(F.lit(LINES - 1), F.size("lines") - 1)))

    return turns.withColumn("lines", lines).withColumn("obs", F.transform("lines", observed))


@dataclass
class Model:
    """Log probabilities: start[state], enter[from, to] at a row's first line, go[from, to] at others, and one table
    [state, value] for each feature."""

    start: np.ndarray
    enter: np.ndarray
    go: np.ndarray
    emit: list[np.ndarray]

    def scores(self, obs: np.ndarray) -> np.ndarray:
        """[line, state] log-likelihoods of observations [line, feature]."""
        return sum(table[:, obs[:, f]].T for f, table in enumerate(self.emit))

    def moves(self, enters: np.ndarray) -> np.ndarray:
        """[line, from, to]: the step into each line."""
        return np.where(enters[:, None, None], self.enter, self.go)


def model_of(start: np.ndarray, turn: np.ndarray, emit: list[np.ndarray]) -> Model:
    """From probabilities: start[role], turn[role, role], emit [state, value]."""
    with np.errstate(divide="ignore"):
        enter, go, first = np.zeros((STATES, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
        first[:N] = start
        enter[:, :N] = np.vstack((turn, turn))
        go[:, :N] = INSIDE * enter[:, :N]
        for s in range(STATES):
            go[s, N + s % N] = 1 - INSIDE
        return Model(np.log(first), np.log(enter), np.log(go), [np.log(e) for e in emit])


def ordered(turns: DataFrame) -> DataFrame:
    """Adds k, the place of a turn in its conversation, and its block. Numbering counts by parts, so that a long
    conversation is no single task: turns are first counted by ranges of ``BLOCK`` turn numbers."""
    part = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long")
    rows = turns.withColumn("part", part)
    counts = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    joined = numbered.alias("r").join(starts.alias("s"), F.col("r.conv").eqNullSafe(F.col("s.conv")) & (F.col("r.part") == F.col("s.part")))
    k = (F.col("before") + F.col("place")).cast("long")
    return joined.select("r.*", k.alias("k")).drop("part", "place").withColumn("block", F.floor(F.col("k") / BLOCK).cast("long"))


def train(turns: DataFrame) -> Model:
    """From turns with k, obs and a known role; counts over all of them. A row's first line begins a turn and its others go
    on with it. A state's table is mixed with what all lines show, by one line's weight, and with ``EVEN`` of all values
    alike, so that a rare state is no better at explaining what none has shown."""
    known = turns.where(F.col("role").isin(*ROLES))
    code = {r: i for i, r in enumerate(ROLES)}
    start, move, emit = np.ones(N), np.ones((N, N)), [np.zeros((STATES, v)) for v in FEATURES.values()]
    lines = known.select("role", F.posexplode("obs").alias("line", "o"))
    cells = lines.select("role", F.col("line") == 0, F.posexplode("o").alias("f", "v")).toDF("role", "begins", "f", "v").groupBy("role", "begins", "f", "v").count()
    for r in cells.collect():  # a row for each state, feature and value
        emit[r["f"]][code[r["role"]] + (0 if r["begins"] else N), r["v"]] += r["count"]
    pairs = known.select("conv", "k", "role").alias("a").join(known.select("conv", (F.col("k") - 1).alias("k"), "role").alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.k") == F.col("b.k")))
    for r in pairs.groupBy(F.col("a.role").alias("x"), F.col("b.role").alias("y")).count().collect():
        move[code[r["x"]], code[r["y"]]] += r["count"]
    for r in known.where("k = 0").groupBy("role").count().collect():
        start[code[r["role"]]] += r["count"]
    share = lambda a: a / a.sum(-1, keepdims=True)
    prior = np.full((STATES, N + 1), 0.001)
    prior[:N, 0], prior[N:, 0] = 0.5, 1.0
    prior[range(N), range(1, N + 1)] = 0.48
    pooled = [share(e.sum(0) + 1e-6) for e in emit]
    shown = [share(e + p) for e, p in zip(emit, pooled)]
    emit = [(1 - TRUST) * shown[0] + TRUST * share(prior), *((1 - EVEN) * e + EVEN / e.shape[1] for e in shown[1:])]
    for e in emit[4:]:
        e[:, 1:] /= e[:, 1:].sum(1, keepdims=True)
        e[:, 0] = 1
    return model_of(share(start), share(move), emit)


def block_matrix(model: Model, obs: np.ndarray, enters: np.ndarray, first: bool) -> np.ndarray:
    """[state before, state at the end] of a block's lines; a first block starts from anywhere alike."""
    s, steps = model.scores(obs), model.moves(enters)
    m = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(m, model.start + s[0] if first else 0.0)
    for t in range(1 if first else 0, len(s)):
        m = (m[:, :, None] + steps[t][None]).max(1) + s[t]
    return np.broadcast_to(m.max(0), m.shape).copy() if first else m


def block_states(model: Model, obs: np.ndarray, enters: np.ndarray, first: bool, before: int, end: int) -> np.ndarray:
    """The best states of a block that end in ``end``, after state ``before``."""
    s, steps = model.scores(obs), model.moves(enters)
    best = (model.start if first else steps[0][before]) + s[0]
    back = np.zeros((len(s), STATES), np.int64)
    for t in range(1, len(s)):
        step = best[:, None] + steps[t]
        back[t] = step.argmax(0)
        best = step.max(0) + s[t]
    states = np.empty(len(s), np.int64)
    states[-1] = end
    for t in range(len(s) - 1, 0, -1):
        states[t - 1] = back[t][states[t]]
    return states


def chain_ends(matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of each block on the best path through all of them."""
    best, backs = matrices[0][0], []
    for m in matrices[1:]:
        step = best[:, None] + m
        backs.append(step.argmax(0))
        best = step.max(0)
    ends = [int(best.argmax())]
    for back in reversed(backs):
        ends.append(int(back[ends[-1]]))
    return ends[::-1]


def lines_of(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(observations, whether a line is its row's first, lines of each row) of rows' arrays of observations."""
    n = np.array([len(r) for r in rows])
    obs = np.array([x for r in rows for x in r], np.int64).reshape(-1, len(FEATURES))
    enters = np.zeros(len(obs), bool)
    enters[np.cumsum(n) - n] = True
    return obs, enters, n


def _per_row(states: np.ndarray, n: np.ndarray) -> list[list[int]]:
    return [x.tolist() for x in np.split(states, np.cumsum(n)[:-1])]


def _matrices(model: Model):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        obs, enters, _ = lines_of(pdf["obs"].to_list())
        m = block_matrix(model, obs, enters, bool(pdf["k"].iloc[0] == 0))
        return pd.DataFrame({"conv": [pdf["conv"].iloc[0]], "block": [pdf["block"].iloc[0]], "m": [m.ravel().tolist()]}).astype({"conv": "Int64"})

    return run


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    ends = chain_ends([np.array(m, float).reshape(STATES, STATES) for m in pdf["m"]])
    return pd.DataFrame({"conv": pdf["conv"].astype("Int64"), "block": pdf["block"], "before": [-1, *ends[:-1]], "end": ends})


def _states(model: Model):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        obs, enters, n = lines_of(pdf["obs"].to_list())
        states = block_states(model, obs, enters, bool(pdf["k"].iloc[0] == 0), int(pdf["before"].iloc[0]), int(pdf["end"].iloc[0]))
        return pd.DataFrame({"conv": pdf["conv"].astype("Int64"), "k": pdf["k"], "states": _per_row(states, n)})

    return run


def solve(model: Model, rows: list) -> list[list[int]]:
    """The states of a whole conversation, row by row."""
    obs, enters, n = lines_of(rows)
    end = int(block_matrix(model, obs, enters, True)[0].argmax())
    return _per_row(block_states(model, obs, enters, True, -1, end), n)


def _short(model: Model):
    """Whole conversations that fit one block, many in a batch; rows come sorted by conversation and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: list[tuple] = []

        def emit(groups: list[list[tuple]]) -> pa.RecordBatch:
            rows = [r for g in groups for r in g]
            states = [x for g in groups for x in solve(model, [r[2] for r in g])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(states, pa.list_(pa.int32()))], ["conv", "k", "states"])

        for b in batches:
            groups: list[list[tuple]] = []
            for row in zip(b.column("conv").to_pylist(), b.column("k").to_pylist(), b.column("obs").to_pylist()):
                if open_rows and row[1] == 0:
                    groups.append(open_rows)
                    open_rows = []
                open_rows.append(row)
            if groups:
                yield emit(groups)
        if open_rows:
            yield emit([open_rows])

    return run


def recover(turns: DataFrame, model: Model) -> DataFrame:
    """(conv, k, states: one for each line) of turns (conv, k, block, obs; read more than once: give a written table)."""
    rows = turns.select("conv", "k", "block", "obs")
    long = rows.where("block > 0").select("conv").distinct()
    same = F.col("r.conv").eqNullSafe(F.col("l.conv"))
    short = rows.alias("r").join(long.alias("l"), same, "left_anti")
    out = "conv long, k long, states array<int>"
    done = short.repartition("conv").sortWithinPartitions("conv", "k").mapInArrow(_short(model), out)
    rest = rows.alias("r").join(long.alias("l"), same, "left_semi")
    matrices = rest.groupBy("conv", "block").applyInPandas(_matrices(model), "conv long, block long, m array<double>")
    ends = matrices.groupBy("conv").applyInPandas(_ends, "conv long, block long, before int, end int")
    tied = rest.alias("r").join(ends.alias("e"), F.col("r.conv").eqNullSafe(F.col("e.conv")) & (F.col("r.block") == F.col("e.block"))).select("r.*", "before", "end")
    return done.unionByName(tied.groupBy("conv", "block").applyInPandas(_states(model), out))


def escape(body: Column) -> Column:
    """A body in which nothing reads as a mark: each ``<|``, with whatever backslashes stand between, gets one more."""
    return F.regexp_replace(body, r"<(\\*)\|", r"<$1\\|")


def render(role: Column, body: Column) -> Column:
    """One turn: its role between marks, its text without outer white space, an end mark."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), escape(F.regexp_replace(body, "^\\s+|\\s+$", "")), F.lit("\n<|end|>\n"))


def parsed(rows: DataFrame) -> DataFrame:
    """rows (lines, states) with one row for each turn in them: part, role_pred and body. A marker that begins a turn is no
    part of its body; any other line stays whole."""
    begins = lambda s: s < N
    bare = F.transform("lines", lambda x, i: F.when(begins(F.get("states", i)) & (_marker(x) > 0), F.regexp_replace(x, _MARKER, "")).otherwise(x))
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | begins(F.get("states", i)))
    cut = rows.withColumn("lines", bare).withColumn("starts", starts)
    until = lambda j: F.coalesce(F.get("starts", j + 1), F.size("lines"))
    turn = lambda i, j: F.struct(j.alias("part"), F.element_at(F.array(*map(F.lit, ROLES)), F.get("states", i) % N + 1).alias("role_pred"), F.array_join(F.slice("lines", i + 1, until(j) - i), "\n").alias("body"))
    return cut.select(*(c for c in rows.columns if c not in ("lines", "states")), F.inline(F.transform("starts", turn)))


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """(conv_id, turn, k, part, role_pred, rendered) of conversations (conv_id, turn, text; role where they train): a row for
    each recovered turn, k being the row's place in its conversation and part the turn's place in the row."""
    turns = conversations.select(F.col("conv_id").alias("conv"), "turn", "text", *(["role"] if "role" in conversations.columns else []))
    seen = C.written(features(ordered(turns)), "turns")
    if model is None:
        labelled = seen if "role" in seen.columns else seen.withColumn("role", F.lit(None).cast("string"))
        model = train(labelled.where(~F.coalesce(C.held_out(F.col("conv")), F.lit(True))))
    states = recover(seen, model)
    met = seen.alias("t").join(states.alias("r"), F.col("t.conv").eqNullSafe(F.col("r.conv")) & (F.col("t.k") == F.col("r.k")))
    out = parsed(met.select(F.col("t.conv").alias("conv_id"), "turn", "t.k", "lines", "states"))
    return out.select("conv_id", "turn", "k", "part", "role_pred", render(F.col("role_pred"), F.col("body")).alias("rendered"))


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """Roles learned from conversations outside the held-out third; no turn's own role is an input of its answer."""
    return format_chats(C.table(spark, sf_dir, "conversations"))
