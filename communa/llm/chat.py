"""Chat formatting: transcripts parsed into turns by a hidden Markov model over lines.

A line shows one symbol, made of its speaker marker, if any, and of features of its text and place. The states are a
role and whether the line opens a turn. Counts of labelled transcripts, with one added to each, give the model;
Viterbi recovers the states of a whole transcript, and turns are written out in one canonical form.

A transcript may be longer than a task should hold. Its lines are dealt into chunks; each chunk is summed up by the best score
from every state to every state, the chunks of a transcript are combined in order, and each chunk then finds its own best path
between the states so fixed. The result is that of one Viterbi pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from communa.llm.common import small_batches, table
from communa.operators.ordering import number_rows
from communa.storage import materialize, owned

ROLES = ("system", "user", "assistant")
#: Words that mark a speaker.
MARKERS = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "q", "question", "prompt", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent", "response"),
}
#: Bound of the labelled transcripts that the model is fitted on; turn numbers and turns of a chunk; chunks of a transcript that are joined at once.
TRAIN_TRANSCRIPTS, CHUNK_TURNS, BUNDLE = 1000, 1024, 1024
#: Longer turns aren't in the training sample.
SAMPLE_CHARS = 20_000
_MARKER = re.compile(r"\s*(?:#+\s*|\*\*|<\|?|\[)?\s*([A-Za-z]{1,14})\s*(?:\*\*|\|?>|\])?\s*:\s?(?:\*\*)?|\s*(?:<\|([A-Za-z]{1,14})\|>|\[([A-Za-z]{1,14})\])\s*")
_ROLE_OF = {w: i + 1 for i, r in enumerate(ROLES) for w in MARKERS[r]}
STATES = 2 * len(ROLES)  # 2 * role + (0 opens a turn, 1 goes on)
SYMBOLS = 5 * 2 * 3 * 2


def marker(line: str) -> tuple[int, int]:
    """(0 none, 1 to 3 a role, 4 another name; length of the marker)."""
    m = _MARKER.match(line)
    if not m:
        return 0, 0
    word = next(g for g in m.groups() if g)
    kind = _ROLE_OF.get(word.lower(), 4)
    return (kind, m.end()) if kind < 4 or word[:1].isupper() else (0, 0)


def symbol(line: str, after_blank: bool) -> int:
    kind, at = marker(line)
    text = line[at:].strip()
    size = 0 if not text else 1 if len(text) < 80 else 2
    return ((kind * 2 + after_blank) * 3 + size) * 2 + text.endswith("?")


def symbols(lines: list[str], after_blank: bool = True) -> np.ndarray:
    """Symbols of consecutive lines; the first of a transcript counts as after a blank one."""
    blank = [after_blank, *(not x.strip() for x in lines[:-1])]
    return np.array([symbol(x, b) for x, b in zip(lines, blank, strict=True)], np.int64)


class Model:
    """Log chances: of a transcript's first state, of a state after another, of a symbol in a state."""

    def __init__(self, transcripts: Iterable[tuple[list[str], list[int]]]):
        """Labelled transcripts: lines and the states of the lines."""
        first, after, shown = np.ones(STATES), np.ones((STATES, STATES)), np.full((STATES, SYMBOLS), 0.1)
        for role in range(len(ROLES)):
            inside = 2 * role + 1
            first[inside] = 1e-9  # a transcript and a turn begin with an opening line of the role
            for state in range(STATES):
                if state // 2 != role:
                    after[state, inside] = 1e-9
        for lines, states in transcripts:
            if lines:
                first[states[0]] += 1
                np.add.at(after, (states[:-1], states[1:]), 1)
                np.add.at(shown, (states, symbols(lines)), 1)
        self.first = np.log(first / first.sum())
        self.after = np.log(after / after.sum(1, keepdims=True))
        self.shown = np.log(shown / shown.sum(1, keepdims=True))

    def span(self, codes: np.ndarray) -> np.ndarray:
        """Best score from the state before a chunk to the state at its end, all symbols of the chunk included."""
        out = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for c in codes:
            out = (out[:, :, None] + self.after[None]).max(1) + self.shown[:, c]
        return out

    def path(self, codes: np.ndarray, start: np.ndarray, end: int | None = None) -> list[int]:
        """Best states of a chunk: ``start`` has the score of each state before it, ``end`` is its last state. Ties go to the lower state."""
        score, back = start, []
        for c in codes:
            both = score[:, None] + self.after
            back.append(both.argmax(0))
            score = both.max(0) + self.shown[:, c]
        state = int(score.argmax()) if end is None else end
        out = []
        for b in reversed(back):
            out.append(state)
            state = int(b[state])
        return out[::-1]

    def decode(self, lines: list[str]) -> list[int]:
        """Viterbi over a whole transcript."""
        if not lines:
            return []
        codes = symbols(lines)
        score, back = self.first + self.shown[:, codes[0]], []
        for c in codes[1:]:
            both = score[:, None] + self.after
            back.append(both.argmax(0))
            score = both.max(0) + self.shown[:, c]
        state = int(score.argmax())
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


def labelled(turns: list[tuple[str, str]], number: int) -> tuple[list[str], list[int]]:
    """A transcript of (role, text) turns as lines, with the states of the lines; ``number`` sets its style of markers. In
    some styles some turns go unmarked, as in transcripts found in the wild."""
    lines, states = [], []
    for i, (role, text) in enumerate(turns):
        r = ROLES.index(role)
        words = MARKERS[role]
        word = words[number // 5 % len(words)]
        style = number % 5
        open_ = (f"{word.capitalize()}: ", f"### {word.capitalize()}:\n", f"**{word.capitalize()}:** ", f"[{word}] ", f"{word.upper()}: ")[style]
        if i and number % 7 == 3 and i % 3 == 2:
            open_ = "\n"
        body = (open_ + text).split("\n")
        lead = 1 if open_ == "\n" else 0
        lines += body
        states += [(2 * ROLES.index(turns[i - 1][0]) + 1) if j < lead else 2 * r + (j > lead) for j in range(len(body))]
    return lines, states


def render(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    """(role, text) turns: markers of the turn's own role are dropped, blank lines at either end too."""
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        role = ROLES[state // 2]
        if state % 2 == 0 or not out:
            kind, at = marker(line)
            out.append((role, [line[at:] if kind == state // 2 + 1 else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(text).strip()) for role, text in out]


def canonical(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


_TURN = "array<struct<role:string,text:string>>"


def parse(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, turns array<(role, text)>, rendered): each text is a whole transcript.

    Null text has no turns and null rendering, empty text one empty turn. Rows that repeat stay; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                lines = None if text is None else text.split("\n")
                found.append(None if lines is None else render(lines, shared.value.decode(lines)))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            turns = pa.array([[{"role": r, "text": t} for r, t in x or []] for x in found], kind)
            yield pa.record_batch([batch.column(0), turns, pa.array([None if x is None else canonical(x) for x in found], pa.string())], ["doc_id", "turns", "rendered"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, turns {_TURN}, rendered string")


def fit(conversations: DataFrame, where: Column | None = None, transcripts: int = TRAIN_TRANSCRIPTS) -> Model:
    """Model from about so many labelled conversations (conv_id, turn, role, text), chosen by hash: their first 64 turns, written out as
    transcripts in the styles of :func:`labelled`. Turns of other roles, or null in any column, are left out."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).dropna()
    rows = rows.filter(F.col("role").isin(*ROLES) & F.col("turn").between(0, 63) & (F.length("text") <= SAMPLE_CHARS))
    rows = rows.filter(where) if where is not None else rows
    number = max(1, rows.agg(F.approx_count_distinct("conv_id")).first()[0])
    picked = rows.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * transcripts / number)))
    turns: dict[int, list[tuple[int, str, str]]] = {}
    for r in picked.distinct().limit(64 * transcripts).collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    return Model(labelled([x[1:] for x in sorted(turns[c])], i) for i, c in enumerate(sorted(turns)))


def _chunk_summary(model: Model, lines: list[str]) -> tuple[list[float], list[float], list[float], bool]:
    """Spans after a line that is not blank and after a blank one, scores of the last states if the chunk is the first, and whether it ends blank."""
    codes = symbols(lines)
    head = model.first + model.shown[:, codes[0]]
    for c in codes[1:]:
        head = (head[:, None] + model.after).max(0) + model.shown[:, c]
    return model.span(symbols(lines, False)).ravel().tolist(), model.span(codes).ravel().tolist(), head.tolist(), not lines[-1].strip()


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores over two spans in a row."""
    return (a[:, :, None] + b[None]).max(1)


def _square(x: list[float]) -> np.ndarray:
    return np.array(x).reshape(STATES, STATES)


def _bundled(chunks: list[dict]) -> tuple[list[float], list[float], list[float], bool]:
    """The summary of chunks in order, as of one chunk."""
    spans = []
    for first in ("span", "wide"):
        total = _square(chunks[0][first])
        for before, x in zip(chunks, chunks[1:], strict=False):
            total = _joined(total, _square(x["wide" if before["blank"] else "span"]))
        spans.append(total.ravel().tolist())
    head = np.array(chunks[0]["head"])
    for before, x in zip(chunks, chunks[1:], strict=False):
        head = (head[:, None] + _square(x["wide" if before["blank"] else "span"])).max(0)
    return *spans, head.tolist(), chunks[-1]["blank"]


def _join_chunks(chunks: list[dict], start: list[float] | None, last: int | None, blank: bool) -> Iterator[tuple[int, int, list[float] | None, int, bool]]:
    """Summaries in order -> (chunk, part, scores of the states before it or None, last state, whether a blank line comes before), last first.
    ``start``, ``last`` and ``blank`` say the same of all of them."""
    score = None if start is None else np.array(start)
    before = []
    for x in chunks:
        span = _square(x["wide" if blank else "span"])
        before.append((score, span, blank))
        score = np.array(x["head"]) if score is None else (score[:, None] + span).max(0)
        blank = x["blank"]
    state = int(score.argmax()) if last is None else last
    for x, (start_, span, blank_) in zip(reversed(chunks), reversed(before), strict=True):
        yield x["chunk"], x["part"], None if start_ is None else start_.tolist(), state, blank_
        if start_ is not None:
            state = int((start_ + span[:, state]).argmax())


def _parted(rows: DataFrame, by: list[str], order: list[str], most: int, name: str) -> tuple[DataFrame, bool]:
    """(rows with a number ``name``, whether it is ever above 0): 0, but in groups of more than ``most`` rows the row's place in them over ``most``.
    Rows of such groups are sorted by ranges, so that no task holds a group."""
    large = materialize(rows.groupBy(*by).agg(F.count("*").alias("rows")).filter(F.col("rows") > most))
    if not large.limit(1).count():
        return rows.withColumn(name, F.lit(0).cast("long")), False
    numbered = number_rows(rows.join(large.select(*by), by, "left_semi"), *by, *order, name="place")
    first = numbered.groupBy(*by).agg(F.min("place").alias("first"))
    placed = numbered.join(first, by).withColumn(name, F.floor((F.col("place") - F.col("first")) / most).cast("long"))
    return rows.join(large, by, "left_anti").withColumn(name, F.lit(0).cast("long")).unionByName(placed.select(*rows.columns, name)), True


_SUMMARY = "conv_id long, chunk long, part long, span array<double>, wide array<double>, head array<double>, blank boolean"
_KNOWN = "conv_id long, chunk long, part long, start array<double>, last int, blank boolean"


def _known(spans: DataFrame, bundle: int) -> DataFrame:
    """Summaries of chunks (_SUMMARY) -> _KNOWN for each, by joining up to ``bundle`` chunks at once, then such bundles, and so on."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, *x) for conv, spans, *outer in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in _join_chunks(spans, *outer)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.bool_())
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in _KNOWN.split(", ")])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(conv, number, 0, *_bundled(spans)) for conv, number, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), *(pa.list_(pa.float64()),) * 3, pa.bool_())
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in _SUMMARY.split(", ")])

    dealt, several = _parted(spans, ["conv_id"], ["chunk", "part"], bundle, "bundle")
    chunks = F.sort_array(F.collect_list(F.struct("chunk", "part", "span", "wide", "head", "blank"))).alias("spans")
    bundles = dealt.groupBy("conv_id", "bundle").agg(chunks)
    if not several:
        return bundles.select("conv_id", "spans", F.lit(None).cast("array<double>"), F.lit(None).cast("int"), F.lit(True)).mapInArrow(join, _KNOWN)
    bundles = materialize(bundles)
    outer = _known(materialize(bundles.select("conv_id", "bundle", "spans").mapInArrow(compose, _SUMMARY)), bundle)
    outer = outer.select("conv_id", F.col("chunk").alias("bundle"), "start", "last", "blank")
    return bundles.join(outer, ["conv_id", "bundle"]).select("conv_id", "spans", "start", "last", "blank").mapInArrow(join, _KNOWN)


@owned
def format_conversations(turns: DataFrame, model: Model, chunk_turns: int = CHUNK_TURNS, bundle: int = BUNDLE) -> DataFrame:
    """(conv_id, turn, text lines of a transcript, truth states or null) -> (conv_id, chunk, part, n_lines, n_turns, n_right, roles, rendered).

    ``turns`` has (conv_id, turn, lines array<string>, truth array<int>); a transcript is its lines in order of turn, null first; rows of one turn
    number are in order of their lines. It is parsed in chunks of ``chunk_turns`` turn numbers, and a chunk of more rows than that, as where turn is null
    or the same in all, in parts of so many. Concatenated in order of chunk and part, the renderings are the canonical conversation (blank lines at the
    seams aside): one begins inside a turn or with the end of the one before. Most conversations are one chunk, 0, of one part, 0. n_turns
    counts turns that open there. Very long texts are lines like any others; conversations without lines, and an empty table, give no rows.
    """
    spark = turns.sparkSession
    shared = spark.sparkContext.broadcast(model)
    chunk = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / chunk_turns).cast("long").alias("chunk")
    dealt, _ = _parted(turns.select("conv_id", chunk, "turn", "lines", "truth"), ["conv_id", "chunk"], ["turn", "lines", "truth"], chunk_turns, "part")
    grouped = dealt.groupBy("conv_id", "chunk", "part").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), "lines", "truth"))).alias("turns"))
    chunks = materialize(grouped.select("conv_id", "chunk", "part", F.flatten("turns.lines").alias("lines"), F.flatten("turns.truth").alias("truth")))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_chunk_summary(shared.value, x) for x in batch.column(3).to_pylist()]
            scores = (pa.array([f[i] for f in found], pa.list_(pa.float64())) for i in range(3))
            yield pa.record_batch([*batch.columns[:3], *scores, pa.array([f[3] for f in found], pa.bool_())], [c.split()[0] for c in _SUMMARY.split(", ")])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, number, part, lines, truth, start, last, blank, final in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = symbols(lines, blank)
                if start is None:
                    lead = shared.value.first + shared.value.shown[:, codes[0]]
                    states = shared.value.path(codes[1:], lead, last)
                    opening = last if len(codes) == 1 else int((lead + shared.value.after[:, states[0]]).argmax())
                    states = [opening, *states]
                else:
                    states = shared.value.path(codes, np.array(start), last)
                found = render(lines, states)
                inside = states[0] % 2 == 1 and start is not None
                text = canonical(found)
                text = text[text.index("\n") + 1 :] if inside else "<|end|>\n" * (start is not None) + text
                text = text if final else text[: -len("\n<|end|>\n")] + "\n"
                right = sum(s // 2 == t // 2 for s, t in zip(states, truth or [], strict=False))
                rows.append((conv, number, part, len(lines), len(found) - inside, right, ",".join(r for r, _ in found[inside:]), text))
            kinds = (*(pa.int64(),) * 6, pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["conv_id", "chunk", "part", "n_lines", "n_turns", "n_right", "roles", "rendered"])

    small_batches(spark)
    full = chunks.filter(F.size("lines") > 0)
    spans = materialize(full.select("conv_id", "chunk", "part", "lines").mapInArrow(summarise, _SUMMARY))
    known = _known(spans, bundle)
    tops = full.groupBy("conv_id").agg(F.max(F.struct("chunk", "part")).alias("top"))
    final = F.struct("chunk", "part") == F.col("top")
    ready = full.join(known, ["conv_id", "chunk", "part"]).join(tops, "conv_id").select("conv_id", "chunk", "part", "lines", "truth", "start", "last", "blank", final.alias("final"))
    return ready.mapInArrow(write, "conv_id long, chunk long, part long, n_lines long, n_turns long, n_right long, roles string, rendered string")


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turn, lines, truth): each turn as the lines it has in a transcript of the style that conv_id
    sets. Rows that repeat in all four columns count once; rows with a null conv_id are left out; a null turn comes first and null
    text counts as empty. A turn of a role that is none of ROLES is marked by that word, a null role by nothing; both count as the user's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = role if role in ROLES else "user"
                text = text or ""
                if known != role and role:
                    text = f"{role.strip().capitalize()}: {text}"
                style, at = conv % 35, turn or 0
                unmarked = style % 7 == 3
                if (unmarked and at and at % 3 == 2) or known != role:
                    lines = text.split("\n")
                    states = [2 * ROLES.index(known), *[2 * ROLES.index(known) + 1] * (len(lines) - 1)]
                else:
                    lines, states = labelled([(known, text)], style)
                if unmarked and (at + 1) % 3 == 2:
                    lines, states = [*lines, ""], [*states, states[-1] // 2 * 2 + 1]
                out.append((conv, turn, lines, states))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["conv_id", "turn", "lines", "truth"])

    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.filter(F.col("conv_id").isNotNull()).distinct().mapInArrow(run, "conv_id long, turn long, lines array<string>, truth array<int>")


def held_out() -> Column:
    """Whether crc32 of conv_id as text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, parsed by a model of those that are not ``held_out``."""
    talks = table(spark, sf_dir, "conversations")
    found = format_conversations(as_transcripts(talks), fit(talks, ~held_out()))
    return found.withColumn("held_out", held_out())
