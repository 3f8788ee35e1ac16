"""Roles of transcript lines by a hidden Markov model, and turns in one canonical form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vigie.session import stored

ROLES = ("system", "user", "assistant")
# A state is a role and whether the line begins a turn; one more stands before the first line.
STATES = tuple((role, begins) for role in ROLES for begins in (True, False))
START = len(STATES)
# Blocks of one conversation that are decoded together; longer ones are joined by their best paths.
CHUNK_BLOCKS = 64
BUCKET_LINES = 50_000
MARKERS = 1000

MARKER = r"^\s*[\[(<*#|]{0,3}\s*([A-Za-z]{1,20})\s*(?:\d{1,3}\s*)?[\])>*|]{0,3}\s?[:>|\])-](?:\s|$)"
# Features, and how many lines of the overall mix each state is given besides its own: markers are
# telling, the others only hint.
FEATURES = {"marker": 0.5, "length": 50.0, "ending": 50.0, "opening": 50.0}


def line_features(line: str = "line") -> list[Column]:
    """A speaker marker in lower case, the length as a power of two, and the kinds of last and first character."""
    text = F.trim(F.col(line))
    marker = F.lower(F.regexp_extract(F.col(line), MARKER, 1))
    last = F.regexp_extract(text, r"([?!.:,;])$", 1)
    first = F.when(text == "", "blank").when(text.rlike(r"^[-*•]|^\d+[.)]"), "list").when(text.rlike(r"^\p{Lu}"), "capital").otherwise("other")
    size = F.floor(F.log2(F.length(text) + 1)).cast("string")
    return [marker.alias("marker"), size.alias("length"), last.alias("ending"), first.alias("opening")]


def lines_of(rows: DataFrame, conversation: str = "conv_id", block: str = "turn", text: str = "text", *more: str) -> DataFrame:
    """Lines of raw transcript blocks with features; a null text is one blank line.

    Rows without a conversation are conversations of their own.
    """
    own = F.concat(F.lit("row "), F.hex(F.xxhash64(F.col(block), F.col(text))))
    split = F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")
    lines = rows.select(
        F.coalesce(F.col(conversation).cast("string"), own).alias("conv"), F.col(conversation).alias("given"),
        F.col(block).cast("long").alias("block"), F.xxhash64(F.col(text)).alias("tie"), *more,
        F.posexplode(split).alias("line_no", "line"))
    return lines.select("conv", "given", "block", "tie", "line_no", "line", *more, *line_features())


@dataclass(frozen=True)
class Model:
    """Log probabilities: per feature a table from value to one number per state, and the moves."""

    tables: tuple[dict[str, np.ndarray], ...]
    moves: np.ndarray

    def emissions(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), START))
        nothing = np.zeros(START)  # a value never seen tells nothing
        for name, table in zip(FEATURES, self.tables):
            codes, values = pd.factorize(frame[name])
            out += np.array([table.get(value, nothing) for value in values])[codes]
        return out


def learn(rows: DataFrame, conversation: str = "conv_id", block: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts of features per state and of moves between states, from blocks of one known role each.

    All counting is done by Spark; what reaches the driver is bounded by states, values and the
    ``MARKERS`` most frequent markers. Rows of other roles, or without a conversation or number,
    teach nothing. Unseen moves and values keep a small probability.
    """
    known = rows.filter(F.col(role).isin(*ROLES) & F.col(conversation).isNotNull() & F.col(block).isNotNull())
    lines = lines_of(known.withColumn("_role", F.col(role)), conversation, block, text, "_role").withColumn(
        "begins", F.col("line_no") == 0)
    state = {key: i for i, key in enumerate(STATES)}
    tables = []
    for name, least in FEATURES.items():
        counted = lines.groupBy("_role", "begins", F.col(name).alias("value")).count()
        top = counted.groupBy("value").agg(F.sum("count").alias("n")).orderBy(F.col("n").desc(), "value").limit(MARKERS)
        found = counted.join(F.broadcast(top.select("value")), "value").collect()
        values = sorted({row.value for row in found})
        counts = {value: np.zeros(START) for value in values}
        for row in found:
            counts[row.value][state[row._role, row.begins]] += row["count"]
        total = sum(counts.values(), np.zeros(START))
        tables.append({
            value: np.log((c + least * c.sum() / total.sum()) / (total + least)) for value, c in counts.items()
        })
    sizes = lines.groupBy("conv", "block", "_role").agg(F.count("*").alias("n"))
    within = sizes.groupBy("_role").agg(
        F.sum("n").alias("lines"), F.count("*").alias("turns"), F.sum((F.col("n") > 1).cast("long")).alias("longer")).collect()
    after = sizes.select("conv", (F.col("block") - 1).alias("block"), F.col("_role").alias("next"))
    between = sizes.select("conv", "block", "_role", (F.col("n") > 1).alias("longer")).join(after, ["conv", "block"]).groupBy(
        "_role", "longer", "next").count().collect()
    opening = sizes.groupBy("conv").agg(F.min_by("_role", "block").alias("_role")).groupBy("_role").count().collect()
    moves = np.full((START + 1, START), 1e-3)
    for row in within:
        moves[state[row._role, True], state[row._role, False]] += row.longer
        moves[state[row._role, False], state[row._role, False]] += row.lines - row.turns - row.longer
    for row in between:
        moves[state[row._role, not row.longer], state[row.next, True]] += row["count"]
    for row in opening:
        moves[START, state[row._role, True]] += row["count"]
    # A turn never begins in its middle, nor goes on with another role's line.
    for role_ in ROLES:
        for i in range(START + 1):
            if i == START or STATES[i][0] != role_:
                moves[i, state[role_, False]] = 1e-12
    return Model(tuple(tables), np.log(moves / moves.sum(axis=1, keepdims=True)))


def path_scores(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best log score through all lines, from each state before them to each state of the last."""
    scores = moves + emissions[0]
    for line in emissions[1:]:
        scores = (scores[:, :, None] + moves[None, :START, :]).max(axis=1) + line
    return scores


def best_path(emissions: np.ndarray, moves: np.ndarray, entry: int, end: int) -> np.ndarray:
    """The states of all lines on the best path between two fixed ends (Viterbi)."""
    score, back = moves[entry] + emissions[0], []
    for line in emissions[1:]:
        trial = score[:, None] + moves[:START]
        back.append(trial.argmax(axis=0))
        score = trial.max(axis=0) + line
    path = [end]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def _groups(frame: pd.DataFrame, keys: list[str], order: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    frame = frame.sort_values(keys + order, kind="stable", na_position="first").reset_index(drop=True)
    rows = list(zip(*(frame[k] for k in keys)))
    at = 0
    for key, group in groupby(rows):
        n = sum(1 for _ in group)
        yield key, frame.iloc[at:at + n]
        at += n


ORDER = ["block", "tie", "line_no"]


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """Per line its ``role`` and whether it ``begins`` a turn.

    Chunks of a conversation are scored for all entry states apart from each other; one row per
    chunk then settles where each is entered and left, and chunks are decoded apart again. So the
    lines of one conversation, however long, are never in one task; its chunks are.
    """
    count = lines.count()
    buckets = max(1, -(-count // BUCKET_LINES))
    chunked = lines.withColumn("chunk", F.coalesce(F.floor(F.col("block") / CHUNK_BLOCKS), F.lit(-1 << 40)).cast("long"))
    chunked = chunked.withColumn("bucket", F.pmod(F.xxhash64("conv", "chunk"), F.lit(buckets)).cast("int"))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        emissions = model.emissions(frame)
        frame = frame.assign(at=np.arange(len(frame)))
        rows = [(conv, chunk, path_scores(emissions[part["at"].to_numpy()], model.moves).ravel().tolist())
                for (conv, chunk), part in _groups(frame, ["conv", "chunk"], ORDER)]
        return pd.DataFrame(rows, columns=["conv", "chunk", "scores"])

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (conv,), part in _groups(frame, ["conv"], ["chunk"]):
            value, back = np.full(START + 1, -np.inf), []
            value[START] = 0.0
            for scores in part["scores"]:
                trial = value[:, None] + np.array(scores).reshape(START + 1, START)
                back.append(trial.argmax(axis=0))
                value = np.append(trial.max(axis=0), -np.inf)
            end, ends = int(value.argmax()), []
            for step in reversed(back):
                entry = int(step[end])
                ends.append((entry, end))
                end = entry
            rows += [(conv, chunk, *pair) for chunk, pair in zip(part["chunk"], reversed(ends))]
        return pd.DataFrame(rows, columns=["conv", "chunk", "entry", "exit"])

    def trace(frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        known = {(c, k): (a, b) for c, k, a, b in zip(ends["conv"], ends["chunk"], ends["entry"], ends["exit"])}
        emissions = model.emissions(frame)
        frame = frame.assign(at=np.arange(len(frame)))
        states = np.zeros(len(frame), int)
        for key, part in _groups(frame, ["conv", "chunk"], ORDER):
            at = part["at"].to_numpy()
            states[at] = best_path(emissions[at], model.moves, *known[key])
        return frame.assign(role=[STATES[s][0] for s in states], begins=[STATES[s][1] for s in states])[list(names)]

    scored = stored(
        chunked.groupBy("bucket").applyInPandas(score, "conv string, chunk long, scores array<double>"), "chunks")
    settled = scored.withColumn("bucket", F.pmod(F.xxhash64("conv"), F.lit(buckets)).cast("int")).groupBy(
        "bucket").applyInPandas(settle, "conv string, chunk long, entry int, exit int")
    settled = settled.withColumn("bucket", F.pmod(F.xxhash64("conv", "chunk"), F.lit(buckets)).cast("int"))
    names = dict.fromkeys([*lines.columns, "role", "begins"])
    kinds = dict(lines.dtypes) | {"role": "string", "begins": "boolean"}
    schema = ", ".join(f"`{name}` {kinds[name]}" for name in names)
    return chunked.groupBy("bucket").cogroup(settled.groupBy("bucket")).applyInPandas(trace, schema)


def canonical(decoded: DataFrame) -> DataFrame:
    """Per block: the roles that begin in it, and its text with each turn under a role header.

    A block that goes on with the turn before has no header at its start, so the blocks of a
    conversation, put one after the other, are the whole canonical text. Markers and blank ends go.
    """
    marked = F.col("begins") & (F.col("marker") != "")
    bare = F.when(marked, F.regexp_replace("line", MARKER, "")).otherwise(F.col("line"))
    header = F.when(F.col("begins"), F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))).otherwise("")
    line = F.struct("line_no", F.col("role").alias("role"), F.col("begins").alias("begins"),
                    F.concat(header, F.rtrim(bare)).alias("text"))
    return (
        decoded.groupBy("conv", "given", "block", "tie")
        .agg(F.array_sort(F.collect_list(line)).alias("lines"))
        .select(
            F.col("given").alias("conv_id"), F.col("block").alias("turn"), F.col("lines")[0]["role"].alias("role"),
            F.transform(F.filter("lines", lambda x: x["begins"]), lambda x: x["role"]).alias("turns"),
            F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("rendered"),
        )
    )


def parse(
    transcripts: DataFrame, model: Model, conversation: str = "conv_id", block: str = "turn", text: str = "text",
) -> DataFrame:
    """Roles and canonical text of raw transcript blocks: ``conv_id``, ``turn``, ``role``, ``turns``, ``rendered``.

    Blocks are taken in the order of their number, null first, equal ones by a hash of the text;
    equal rows of one conversation are one row. Extra columns are not carried. No rows give no rows.
    """
    rows = transcripts.select(conversation, block, text).distinct()
    return canonical(decode(stored(lines_of(rows, conversation, block, text), "lines"), model))


# Ways in which exported transcripts name the speaker of a turn.
SPEAKERS = {
    "system": ("System: ", "[system] ", "Instructions: "),
    "user": ("User: ", "Human: ", "Q: ", "[user] "),
    "assistant": ("Assistant: ", "AI: ", "A: ", "Bot> "),
}


def transcribe(conversations: DataFrame) -> DataFrame:
    """Turns as a raw export would have them: most begin with some marker, every fifth with none."""
    drawn = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(60))
    marker = F.lit("")
    for role, names in SPEAKERS.items():
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(drawn, F.lit(len(names))) + 1).cast("int"))
        marker = F.when(F.col("role") == role, pick).otherwise(marker)
    marker = F.when(F.floor(drawn / 12) == 0, "").otherwise(marker)
    return conversations.withColumn("text", F.when(F.col("text").isNotNull(), F.concat(marker, F.col("text"))))
