"""Chat transcripts: roles recovered by a hidden Markov model over lines.

A line is seen through a few features: the kind of speaker marker at its start,
whether a blank line came before, its length class and how it ends.  The hidden
state is the line's role and whether it opens a turn.  The model is counted from
transcripts whose roles are known (one aggregation, whose result has a row per
state and feature value, whatever the number of lines), Viterbi finds the best
path, and the turns are rendered in one canonical form without their markers.

A conversation is read in blocks of `BLOCK` turns, so a very long one spreads over
tasks; each block starts afresh.

Defined results: a null text is an empty turn; rows with a null role or turn are
read like any other, roles outside the three known ones don't train the model;
a null conv_id is a conversation of its own; repeated rows repeat turns; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import pick, table

ROLES = ("system", "user", "assistant")
BLOCK = 256
#: Words that mark a speaker, by role.
MARKERS = {
    "system": ("system", "context", "instructions"),
    "user": ("user", "human", "q", "question", "instruction", "customer", "prompter"),
    "assistant": ("assistant", "ai", "a", "answer", "response", "bot", "gpt", "agent"),
}
ROLE_OF = {word: role for role, names in MARKERS.items() for word in names}
MARKER = re.compile(r"^\s*(?:(?:#{1,4}\s*|\*{0,2}\[?)(\w+)\]?\*{0,2}\s*:|<\|?(\w+)\|?>)\*{0,2}[ \t]*", re.ASCII)
#: Renderings of transcripts as they are met; None has no markers but blank lines between turns.
STYLES = (
    ("User: {}", "Assistant: {}", "System: {}"),
    ("Human: {}", "AI: {}", "System: {}"),
    ("### Instruction:\n{}", "### Response:\n{}", "### System:\n{}"),
    ("Q: {}", "A: {}", "Context: {}"),
    ("<|user|>\n{}", "<|assistant|>\n{}", "<|system|>\n{}"),
    None,
)


def marker(line: str) -> tuple[str | None, str]:
    """The role that a line's marker names, and the line without it."""
    m = MARKER.match(line)
    role = ROLE_OF.get((m[1] or m[2]).lower()) if m else None
    return (role, line[m.end() :]) if role else (None, line)


def features(lines: list[str]) -> list[tuple[str, ...]]:
    """What the model sees of each line that isn't blank: marker, gap before, length class, ending."""
    seen, blank = [], True
    for line in lines:
        if not line.strip():
            blank = True
            continue
        role, rest = marker(line)
        size = min(4, len(rest.strip()).bit_length() // 2)
        end = rest.rstrip()[-1:]
        seen.append((role or "none", "gap" if blank else "on", f"len{size}", end if end in "?!.:" and end else "other"))
        blank = False
    return seen


STATES = tuple((role, opens) for role in ROLES for opens in (True, False))


@dataclass
class Model:
    """Log probabilities: start and step[state][state] of states, emit[slot][state][value] of features."""

    start: list[float]
    step: list[list[float]]
    emit: list[list[dict[str, float]]]
    floor: list[list[float]]

    def path(self, seen: list[tuple[str, ...]]) -> list[int]:
        """The best state of every line (Viterbi)."""
        if not seen:
            return []
        n = range(len(STATES))
        told = lambda s, x: sum(e[s].get(v, f[s]) for e, f, v in zip(self.emit, self.floor, x, strict=True))
        score = [self.start[s] + told(s, seen[0]) for s in n]
        back = []
        for x in seen[1:]:
            best = [max(n, key=lambda p, s=s: score[p] + self.step[p][s]) for s in n]
            score = [score[best[s]] + self.step[best[s]][s] + told(s, x) for s in n]
            back.append(best)
        at = max(n, key=score.__getitem__)
        path = [at]
        for best in reversed(back):
            at = best[at]
            path.append(at)
        return path[::-1]

    @classmethod
    def from_counts(cls, counts: dict[tuple[str, int, str], int]) -> Model:
        """counts: ("start", state, ""), ("step<p>", state, "") and ("emit<slot>", state, value) -> n.  Every count is raised by one half."""
        n = len(STATES)
        log = lambda part, whole: math.log(part) - math.log(whole)

        def spread(name: str, allowed: list[bool]) -> list[float]:
            raw = [counts.get((name, s, ""), 0) + 0.5 if ok else 0.0 for s, ok in enumerate(allowed)]
            return [log(r, sum(raw)) if r else -1e9 for r in raw]

        opens = [o for _, o in STATES]
        start = spread("start", opens)
        step = [spread(f"step{p}", [opens[s] or STATES[s][0] == STATES[p][0] for s in range(n)]) for p in range(n)]
        emit, floor = [], []
        for slot in range(4):
            rows = [{v: c for (name, s, v), c in counts.items() if name == f"emit{slot}" and s == k} for k in range(n)]
            values = len({v for r in rows for v in r}) + 1
            whole = [sum(r.values()) + 0.5 * values for r in rows]
            emit.append([{v: log(c + 0.5, w) for v, c in r.items()} for r, w in zip(rows, whole, strict=True)])
            floor.append([log(0.5, w) for w in whole])
        return cls(start, step, emit, floor)


def blocks(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, turns): turns as (turn, role, text) in order, at most BLOCK of them unless turn numbers repeat."""
    df = pick(conversations, "conv_id", "turn", "role", "text")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).cast("long").alias("block")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def render(style: int, turns: list[tuple[str, str]]) -> str:
    """A transcript in one of STYLES, from (role, text)."""
    form = STYLES[style]
    if form is None:
        return "\n\n".join(text for _, text in turns)
    by = dict(zip(("user", "assistant", "system"), form, strict=True))
    return "\n".join(by.get(role, "{}").replace("{}", text, 1) for role, text in turns)


def truth(style: int, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """Role and whether it opens a turn, of every line of `render` that isn't blank."""
    out = []
    for role, _ in turns:
        own = render(style, [(role, _)])
        lines = [x for x in own.split("\n") if x.strip()]
        out += [(role, k == 0) for k in range(len(lines))]
    return out


def count_lines(rows: list[tuple[int, list[tuple[str, str]]]]) -> dict[tuple[str, int, str], int]:
    """The counts that Model.from_counts takes, of transcripts (style, turns)."""
    counts: dict[tuple[str, int, str], int] = {}

    def add(*key) -> None:
        counts[key] = counts.get(key, 0) + 1

    number = {s: k for k, s in enumerate(STATES)}
    for style, turns in rows:
        before = None
        for state, seen in zip(truth(style, turns), features(render(style, turns).split("\n")), strict=True):
            s = number.get(state)
            if s is not None:
                add("start" if before is None else f"step{before}", s, "")
                for slot, value in enumerate(seen):
                    add(f"emit{slot}", s, value)
            before = s
    return counts


def style_of(seed: str = "style"):
    return F.pmod(F.xxhash64(F.lit(seed), "conv_id", "block"), F.lit(len(STYLES))).cast("int")


def _turns(value) -> list[tuple[str, str]]:
    return [(t["role"], t["text"]) for t in value]


def train(transcripts: DataFrame) -> Model:
    """The model of transcripts (style, turns) with known roles; counts cover all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, str], int] = {}
        for batch in batches:
            for key, n in count_lines([(s, _turns(t)) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]).items():
                total[key] = total.get(key, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int32()), pa.array([k[2] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["name", "state", "value", "n"])

    counts = transcripts.select("style", "turns").mapInArrow(run, "name string, state int, value string, n long")
    return Model.from_counts({(r[0], r[1], r[2]): r[3] for r in counts.groupBy("name", "state", "value").agg(F.sum("n")).collect()})


def parse(model: Model, text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a transcript, without markers."""
    lines = text.split("\n")
    states = iter(model.path(features(lines)))
    turns: list[tuple[str, list[str]]] = []
    gap = 0
    for line in lines:
        if not line.strip():
            gap += 1
            continue
        role, opens = STATES[next(states)]
        rest = marker(line)[1]
        if opens or not turns:
            turns.append((role, [rest] if rest.strip() else []))
        else:
            turns[-1][1].extend([""] * gap + [rest])
        gap = 0
    return [(role, "\n".join(body)) for role, body in turns]


def canonical(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


PARSED = "n_turns long, n_found long, n_lines long, n_right long, roles string, rendered string"


def format_chats(transcripts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, block, ...) of transcripts (conv_id, block, style, turns): what the parser makes of their rendering, and on how many lines its roles are right."""
    df = transcripts.select("conv_id", "block", "style", "turns")
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for style, value in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns = _turns(value)
                text = render(style, turns)
                known = truth(style, turns)
                told = [STATES[s] for s in model.path(features(text.split("\n")))]
                found = parse(model, text)
                rows.append((len(turns), len(found), len(known), sum(a[0] == b[0] for a, b in zip(known, told, strict=True)), ",".join(r for r, _ in found), canonical(found)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["conv_id", "block", "n_turns", "n_found", "n_lines", "n_right", "roles", "rendered"])

    return df.mapInArrow(run, f"conv_id {kind}, block long, {PARSED}")


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    transcripts = blocks(table(spark, sf_dir, "conversations")).withColumn("style", style_of())
    return format_chats(transcripts, train(transcripts))
