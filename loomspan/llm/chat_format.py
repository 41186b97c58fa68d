"""Chat formatting with a black-box template: spans of turns found by rendering successive turn prefixes.

A template is any function from a list of (role, text) to a string. Each prefix of a conversation is
rendered; what an output has more than the one before it is the span of the turn that was added. Where an
output does not begin with the one before it, the template rewrote history there, which is reported with
the number of code points it took back. The part of a span under the loss mask is found with a probe: the
same prefix, its last text replaced by a word that stands nowhere else, shows what the template puts before
and after a text.

Every prefix is rendered from the conversation's first turn, whatever its length. Conversations are dealt whole to
tasks. Those whose rendering is much work (``WORK``; a third of all turns may be one conversation) are range-partitioned
by (conversation, turn) instead, and each task then gets, before its own turns, all earlier ones of the conversation that its
first turn goes on with. Rendering all prefixes of a template that is not looked into takes time with the square of a
conversation's length, and a task holds the longest prefix that it renders: both are in the nature of the method.
Digests are made while turns stream by; conversations that are spread go on to a second, small shuffle as pieces.

Rows are ordered by turn (null first), then role, then text. A null id is a conversation of its own. Null
roles and texts are empty. Repeated rows are turns of their own. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.support import partitions, text_batches, written

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
WINDOW = 16  # turns: a conversation up to this length is never spread over tasks
WORK = 1 << 28  # turns times code points (64 more a turn, for what a template adds): beyond, a conversation is spread over tasks
PIECE_BYTES = 1 << 20  # of a conversation's digested text in one row, on the way to another task
PROBE = "probe"
LOSS_ROLES = ("assistant",)

SPANS = "conv_id bigint, part int, seq bigint, role string, formatted string, mask_start int, mask_stop int, taken_back int"
_Batches = Iterator[pa.RecordBatch]

# --- a template with control strings, and the way back

_START, _STOP = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.DOTALL)
_CONTROL = re.compile(r"<(\\*)\|")


def escape(text: str) -> str:
    """No control string is left in the result: a backslash more stands between ``<`` and ``|``."""
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_out(role: str) -> str:
    """A role in one line: line ends and backslashes written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chatml(turns: Sequence[Turn]) -> str:
    """``<|im_start|>role``, the escaped text and ``<|im_end|>``, turn by turn."""
    return "".join(f"{_START}{_role_out(role)}\n{escape(text)}{_STOP}\n" for role, text in turns)


def read_chatml(span: str) -> Turn:
    """(role, text) of one turn's span."""
    m = _TURN.fullmatch(span)
    if m is None:
        raise ValueError("not the span of one turn")
    return _role_back(m[1]), unescape(m[2])


# --- spans

class Prefixes:
    """Renders a conversation turn by turn; ``add`` gives the turn's span, its loss mask and what was taken back."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.turns: list[Turn] = []
        self.out: str | None = template([])

    def pass_over(self, turn: Turn) -> None:
        """An earlier turn, whose span another task finds."""
        self.turns.append(turn)
        self.out = None

    def add(self, turn: Turn, masked: bool) -> tuple[str, int | None, int | None, int]:
        if self.out is None:
            self.out = self.template(self.turns)
        out = self.template([*self.turns, turn])
        keeps = len(self.out) if out.startswith(self.out) else len(os.path.commonprefix([out, self.out]))
        span, start, stop = out[keeps:], None, None
        if masked and keeps == len(self.out):
            head, found, tail = self.template([*self.turns, (turn[0], PROBE)])[keeps:].partition(PROBE)
            if found and span.startswith(head) and span.endswith(tail) and len(span) >= len(head) + len(tail):
                start, stop = len(head), len(span) - len(tail)
        taken_back = len(self.out) - keeps
        self.turns.append(turn)
        self.out = out
        return span, start, stop, taken_back


def _render(template: Template, loss_roles: Sequence[str]) -> Callable[[_Batches], _Batches]:
    names = ["conv_id", "part", "seq", "role", "formatted", "mask_start", "mask_stop", "taken_back"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: _Batches) -> _Batches:
        n, last, prefixes = 0, object(), None
        for batch in batches:
            rows = []
            for conv, role, text, part, seq, own in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if conv != last:
                    last, prefixes = conv, Prefixes(template)
                if not own:
                    prefixes.pass_over((role, text))
                    continue
                rows.append((conv, part, n if seq is None else seq, role, *prefixes.add((role, text), role in loss_roles)))
                n += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _spread(rows: DataFrame, n_parts: int) -> DataFrame:
    """``(conv_id, role, text, part, seq, own)``: rows in order, dealt out by ranges; before its own rows, each part has
    those of earlier parts that begin the conversation which its first row goes on with."""
    order = ["conv_id", "turn", "role"]
    sorted_rows = rows.repartitionByRange(n_parts, *order, F.left("text", F.lit(32))).sortWithinPartitions(*order, "text")
    placed = written(sorted_rows.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("seq")), "chat-turns")
    at = F.shiftright("seq", 33).cast("int")  # that id counts rows within a partition, whose number stands above
    parts = placed.select(F.col("conv_id").alias("of"), at.alias("part")).distinct()
    met = placed.join(parts, _same("conv_id", "of") & (at <= F.col("part")))
    dealt = met.select("conv_id", "role", "text", "part", "seq", (at == F.col("part")).alias("own"))
    return dealt.repartitionById(n_parts, "part").sortWithinPartitions("part", "conv_id", "seq")


def turn_spans(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, *, template: Template = chatml, loss_roles: Sequence[str] = LOSS_ROLES) -> DataFrame:
    """``SPANS``, one row a turn, in order within a task: ``formatted`` is what the turn adds to the conversation's
    output, ``mask_start`` and ``mask_stop`` the code points of it that are under the loss mask (null: none, or not to
    be located), ``taken_back`` the code points of earlier output that the template rewrote, ``part`` the place of the
    task among those that share the conversation (null: it is the only one).

    The outputs of a conversation are its spans by (part, seq), joined, as long as nothing was taken back.
    """
    empty = F.lit("")
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"), F.col(turn_col).alias("turn"))
    n_parts = partitions(rows)
    sizes = rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.count("*").cast("double").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = written(sizes.where((F.col("n") > WINDOW) & (F.col("n") * (F.col("chars") + 64 * F.col("n")) > WORK)).select("long_id"), "chat-long")
    any_long = not long.isEmpty()
    short = rows.join(long, _same("conv_id", "long_id"), "left_anti") if any_long else rows
    dealt = short.repartition(n_parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    whole = dealt.select("conv_id", "role", "text", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("seq"), F.lit(True).alias("own"))
    found = text_batches(whole).mapInArrow(_render(template, loss_roles), SPANS)
    if not any_long:
        return found
    spread = _spread(rows.join(long, _same("conv_id", "long_id"), "left_semi"), n_parts)
    return found.unionByName(text_batches(spread).mapInArrow(_render(template, loss_roles), SPANS))


# --- digests, read back from the output

_DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_PIECE = ["part", "seq", "turns", "loss"]  # of a conversation that is spread: its text instead of digests
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_rewrites bigint"
PIECES = f"{DIGESTS}, part int, seq bigint, turns binary, loss binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [*_DIGEST_TYPES, pa.int32(), pa.int64(), pa.binary(), pa.binary()][: len(rows[0])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*_DIGEST, *_PIECE][: len(types)])


class _Text:
    """What a conversation says, as read back so far."""

    def __init__(self, conv: int | None, part: int | None, seq: int) -> None:
        self.conv, self.part, self.seq = conv, part, seq
        self.turns, self.loss = [], []
        self.n = self.chars = self.loss_chars = self.rewrites = self.size = 0

    def add(self, span: str, turn: Turn, masked: str, taken_back: int) -> None:
        said = f"{turn[0]}\n{turn[1]}\n".encode("utf-8", "surrogatepass")
        loss = masked.encode("utf-8", "surrogatepass")
        self.turns.append(said)
        self.loss.append(loss)
        self.n += 1
        self.chars += len(span) - taken_back
        self.loss_chars += len(masked)
        self.rewrites += taken_back > 0
        self.size += len(said) + len(loss)

    def digest(self) -> tuple:
        return (self.conv, self.n, hashlib.sha256(b"".join(self.turns)).hexdigest(), self.loss_chars, hashlib.sha256(b"".join(self.loss)).hexdigest(), self.chars, self.rewrites, None, None, None, None)

    def piece(self) -> tuple:
        """What a task has of a conversation: its digest, if no other task has turns of it."""
        if self.part is None:
            return self.digest()
        return (self.conv, self.n, None, self.loss_chars, None, self.chars, self.rewrites, self.part, self.seq, b"".join(self.turns), b"".join(self.loss))


def _read(read_back: Callable[[str], Turn], unmask: Callable[[str], str]) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        now: _Text | None = None
        for batch in batches:
            rows = []
            for conv, part, seq, span, a, b, taken_back in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if now is None or (conv, part) != (now.conv, now.part) or (part is not None and now.size >= PIECE_BYTES):
                    if now is not None:
                        rows.append(now.piece())
                    now = _Text(conv, part, seq)
                now.add(span, read_back(span), "" if a is None else unmask(span[a:b]), taken_back)
            if rows:
                yield _batch(rows)
        if now is not None:
            yield _batch([now.piece()])

    return run


def _join(batches: _Batches) -> _Batches:
    """Digests of conversations whose pieces come in order."""
    conv, sums, n = object(), [hashlib.sha256(), hashlib.sha256()], [0] * 4
    begun = False

    def whole() -> tuple:
        return (conv, n[0], sums[0].hexdigest(), n[1], sums[1].hexdigest(), n[2], n[3])

    for batch in batches:
        rows = []
        for c, turns, loss, *counts in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if c != conv or not begun:
                if begun:
                    rows.append(whole())
                conv, sums, n, begun = c, [hashlib.sha256(), hashlib.sha256()], [0] * 4, True
            sums[0].update(turns)
            sums[1].update(loss)
            n = [a + b for a, b in zip(n, counts)]
        if rows:
            yield _batch(rows)
    if begun:
        yield _batch([whole()])


def digests(spans: DataFrame, *, read_back: Callable[[str], Turn] = read_chatml, unmask: Callable[[str], str] = unescape) -> DataFrame:
    """``DIGESTS`` of each conversation, from its spans as ``turn_spans`` gives them (the same tasks read them back).

    ``turns_sha256`` digests role, line end, text, line end of each turn; ``loss_sha256`` the text under the loss mask.
    ``n_rewrites`` counts the turns at which the template rewrote history: there the spans are no whole output.
    """
    read = spans.select("conv_id", "part", "seq", "formatted", "mask_start", "mask_stop", "taken_back").mapInArrow(_read(read_back, unmask), PIECES)
    found = written(read, "chat-digests")
    pieces = found.where(F.col("part").isNotNull()).select("conv_id", "turns", "loss", "n_turns", "loss_chars", "formatted_chars", "n_rewrites", "part", "seq")
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return found.where(F.col("part").isNull()).select(*_DIGEST).unionByName(dealt.mapInArrow(_join, DIGESTS))
