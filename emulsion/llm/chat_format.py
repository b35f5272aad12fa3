"""Chat formatting: a hidden Markov model over the lines of a transcript recovers who speaks, then turns are rendered.

Hidden states are ROLES.  A line shows a speaker marker (the row's role on its first line, or a marker at the start of a
later line, such as "User:" or "### Assistant:"), and features: its length class, whether it asks, whether it continues a row.  Markers are
trusted but not blindly; lines without one follow from the features and the order of speakers.  Emission rates of the length
classes are counted from all rows with a known role; the rest are the fixed rates below.

Rows are put in order by a range partition over (conversation, turn, role, hash of the text) and their number, so that neither a conversation nor
a repeated row has to fit one task.  Viterbi runs over chunks, the rows of a conversation in one partition of about CHUNK_BYTES: a
conversation of one chunk is decoded at once; a longer one first gets, for each chunk, the best score from any state before to any state at its end (a
max-plus matrix), the matrices of a conversation are then chained, and each chunk is decoded between the two states so fixed.

Defined cases: null texts are empty lines and rendered as such; unknown or null roles are recovered; rows are ordered by
(turn, role, hash of the text), nulls first, so repeated rows have a place; of paths of equal score any may be taken; a null conversation is one of its own; an empty table
gives an empty result; a text of any length is one row, in memory of a few times its size; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _spark as S

ROLES = ("system", "user", "assistant", "tool")
CHUNK_BYTES = 8 << 20
# Names that transcripts use for the roles
NAMES = {
    "system": "system", "instruction": "system", "instructions": "system", "user": "user", "human": "user", "prompter": "user", "question": "user",
    "q": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "answer": "assistant",
    "a": "assistant", "tool": "tool", "function": "tool",
}
MARKER = re.compile(r"^\s*(?:<\|(?:im_start\|>)?|#{1,4}\s*|\*\*|\[)?\s*([A-Za-z]{1,12})\s*(?:\|>|\*\*|\])?\s*(?::|(?<=\|>)|(?<=\]))\s*")
LENGTHS = (80, 250, 600)
TRUST = 0.97
START = np.log([0.3, 0.6, 0.08, 0.02])
#: To the next speaker: from the row's state to the column's.
NEXT = np.log([[0.02, 0.94, 0.03, 0.01], [0.01, 0.06, 0.90, 0.03], [0.01, 0.86, 0.06, 0.07], [0.01, 0.04, 0.90, 0.05]])
#: Within a row that shows no new marker the speaker stays.
STAY = np.log(np.where(np.eye(4) > 0, 0.985, 0.005))
ASKS = np.log([[0.95, 0.05], [0.6, 0.4], [0.9, 0.1], [0.97, 0.03]])
TOKENS = ("<|{role}|>\n", "\n<|end|>\n")
N = len(ROLES)


def name_of(marker: str | None) -> int:
    return ROLES.index(NAMES[marker.strip().lower()]) if marker and marker.strip().lower() in NAMES else -1


def lines_of(role: str | None, text: str | None):
    """(text without marker, marker state or -1, starts a row) of each line of a row; a row has one line at least."""
    for k, line in enumerate((text or "").split("\n")):
        m = MARKER.match(line)
        named = name_of(m[1]) if m else -1
        if named >= 0:
            yield line[m.end() :], named, True
        else:
            yield line, name_of(role) if k == 0 else -1, k == 0


def emission(line: str, marker: int, starts: bool, row_chars: int, lengths: np.ndarray) -> np.ndarray:
    out = ASKS[:, int(line.rstrip().endswith("?"))].copy()
    if starts:
        out += lengths[:, int(np.searchsorted(LENGTHS, row_chars))]
    if marker >= 0:
        hit = np.full(N, np.log((1 - TRUST) / (N - 1)))
        hit[marker] = np.log(TRUST)
        out += hit
    return out


class Chunk:
    """The observations of some rows in order."""

    def __init__(self, rows, lengths: np.ndarray):
        self.rows, self.lines, self.e, self.t = rows, [], [], []
        for i, (_, role, text) in enumerate(rows):
            for line, marker, starts in lines_of(role, text):
                self.lines.append((i, line))
                self.e.append(emission(line, marker, starts, len(text or ""), lengths))
                self.t.append(NEXT if starts else STAY)

    def matrix(self) -> np.ndarray:
        """Best score from each state before the chunk to each state at its end."""
        m = np.where(np.eye(N) > 0, 0.0, -np.inf)
        for e, t in zip(self.e, self.t, strict=True):
            m = (m[:, :, None] + t[None]).max(1) + e
        return m

    def decode(self, entry: int | None, leave: int | None) -> list[int]:
        back, score = [], None
        for k, (e, t) in enumerate(zip(self.e, self.t, strict=True)):
            if k == 0 and entry is None:
                score, b = START + e, np.zeros(N, int)
            else:
                step = t[entry][None] if k == 0 else score[:, None] + t
                b = np.full(N, entry) if k == 0 else step.argmax(0)
                score = step.max(0) + e
            back.append(b)
        at = int(score.argmax()) if leave is None else leave
        out = [at]
        for b in back[:0:-1]:
            at = int(b[at])
            out.append(at)
        return out[::-1]


def chain(matrices: list[np.ndarray]) -> list[tuple[int | None, int]]:
    """(state before, state at the end) of each chunk of a conversation on the best path."""
    best, back = None, []
    for k, m in enumerate(matrices):
        step = m if k == 0 else best[:, None] + m
        back.append(step.argmax(0))
        best = step.max(0)
    at = int(best.argmax())
    ends = [at]
    for b in back[:0:-1]:
        at = int(b[at])
        ends.append(at)
    ends = ends[::-1]
    return [(None if k == 0 else ends[k - 1], s) for k, s in enumerate(ends)]


def _groups(batches):
    """(key, rows, entry, leave) of sorted rows, with rows as (turn, role, text)."""
    key, rows, ends = None, [], (None, None)
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "chunk", "turn", "role", "text", "entry", "leave")]
        for conv, chunk, turn, role, text, entry, leave in zip(*cols, strict=True):
            if rows and key != (conv, chunk):
                yield key, rows, *ends
                rows = []
            key, ends = (conv, chunk), (entry, leave)
            rows.append((turn, role, text))
    if rows:
        yield key, rows, *ends


def length_rates(turns: DataFrame) -> np.ndarray:
    """Log rates of the length classes by role, counted over all rows whose role is known; a table of 16 numbers."""
    known = F.create_map(*(x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v))))
    bucket = sum((F.coalesce(F.length("text"), F.lit(0)) > x).cast("int") for x in LENGTHS)
    rows = turns.select(F.try_element_at(known, F.lower(F.trim("role"))).alias("r"), bucket.alias("b")).where("r is not null").groupBy("r", "b").count().collect()
    n = np.ones((N, len(LENGTHS) + 1))
    for x in rows:
        n[ROLES.index(x.r), x.b] += x["count"]
    return np.log(n / n.sum(1, keepdims=True))


def parse(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text, rendered): the recovered turns; a row that holds several speakers gives several parts."""
    lengths = length_rates(turns)
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    scratch = S.Scratch(turns.sparkSession, "chat")
    size = turns.agg(F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    keys = ["conv_id", "turn", "role", "h", "m"]
    turns = turns.withColumn("h", F.xxhash64("text")).withColumn("m", F.monotonically_increasing_id())
    turns = turns.repartitionByRange(int(size) // CHUNK_BYTES + 1, *keys).sortWithinPartitions(*keys).withColumn("chunk", F.spark_partition_id().cast("long"))
    turns = scratch.put("turns", turns)
    long = turns.groupBy("conv_id").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("c"))
    none = [F.lit(None).cast("int").alias(x) for x in ("entry", "leave")]
    order = ("conv_id", "chunk", "turn", "role", "h", "m", "text")

    def matrices(batches):
        for (conv, chunk), rows, _, _ in _groups(batches):
            m = Chunk(rows, lengths).matrix()
            # the first chunk of a conversation starts from the start rates
            first = Chunk(rows, lengths)
            s = START + first.e[0]
            for e, t in zip(first.e[1:], first.t[1:], strict=True):
                s = (s[:, None] + t).max(0) + e
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "chunk": chunk, "m": [*m.ravel().tolist(), *s.tolist()]}], pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("m", pa.list_(pa.float64()))]))

    def chained(batches):
        for batch in batches:
            for conv, parts in zip(batch.column("c").to_pylist(), batch.column("ms").to_pylist(), strict=True):
                parts = sorted(parts, key=lambda p: p["chunk"])
                ms = [np.array(p["m"][N * N :])[None].repeat(N, 0) if k == 0 else np.array(p["m"][: N * N]).reshape(N, N) for k, p in enumerate(parts)]
                ends = chain(ms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv] * len(parts), pa.int64()), pa.array([p["chunk"] for p in parts], pa.int64()), pa.array([e for e, _ in ends], pa.int32()), pa.array([x for _, x in ends], pa.int32())],
                    ["c", "k", "entry", "leave"],
                )

    part = turns.join(long, turns["conv_id"].eqNullSafe(long["c"]), "left_semi").select(*order, *none)
    ms = part.repartition("conv_id", "chunk").sortWithinPartitions(*order[:-1]).mapInArrow(matrices, "conv_id long, chunk long, m array<double>")
    ends = ms.groupBy(F.col("conv_id").alias("c")).agg(F.collect_list(F.struct("chunk", "m")).alias("ms")).mapInArrow(chained, "c long, k long, entry int, leave int")
    ready = turns.join(ends, turns["conv_id"].eqNullSafe(ends["c"]) & (turns["chunk"] == ends["k"]), "left").select(*order, "entry", "leave")

    def decoded(batches):
        out, size = [], 0
        kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("rendered", pa.string())])
        for (conv, _), rows, entry, leave in _groups(batches):
            c = Chunk(rows, lengths)
            states = c.decode(entry, leave)
            at, part = 0, 0
            while at < len(states):
                i, s, to = c.lines[at][0], states[at], at
                part = part + 1 if at and c.lines[at - 1][0] == i else 0
                while to < len(states) and c.lines[to][0] == i and states[to] == s:
                    to += 1
                text = "\n".join(x for _, x in c.lines[at:to])
                shown = TOKENS[0].format(role=ROLES[s]) + text.strip() + TOKENS[1]
                out.append({"conv_id": conv, "turn": rows[i][0], "part": part, "role": ROLES[s], "text": text, "rendered": shown})
                size += 2 * len(text)
                at = to
            if size > 1 << 21:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return ready.repartition("conv_id", "chunk").sortWithinPartitions(*order[:-1]).mapInArrow(decoded, "conv_id long, turn long, part int, role string, text string, rendered string")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse(S.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return out.select("conv_id", "turn", "part", "role", F.length("text").cast("long").alias("n_chars"), F.crc32(F.col("rendered").cast("binary")).alias("rendered_crc32"))
