"""Chat formatting with spans found by rendering, not by knowing the template.

A template is any function from a list of turns to a string. Successive prefixes
of a conversation are rendered; where an output starts with the previous one,
the rest is the new turn's span. Where it does not, the template has rewritten
history, which is recorded with the place of the first change. Inside a span the
content is found by probing: the same turns rendered with two different short
texts and with an empty one give the content's place. Probes see the turn behind
the one before it if that renders the very same span, else the whole prefix, so a
turn costs one rendering of its prefix and a few of two turns.

Defined results
  A null role or text counts as empty. Turns are ordered by turn, then role,
  then text, nulls first, so ties and repeated rows have one order. A null
  conv_id is one conversation of its own. An empty table gives no rows. Texts of
  any length are rendered whole; a conversation is one task's, and rendering its
  prefixes is quadratic in its turns. Other columns are ignored, so names can't
  clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Characters of output gathered before they are passed on.
FLUSH = 4_000_000
#: Control strings: what marks turns here and in other common templates.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
_TURN = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """Double backslashes, and put one behind the first sign of a control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_template(turns: list[Turn]) -> str:
    """Marks every turn; control strings inside roles and texts are escaped."""
    return "".join(f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{CLOSE}" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """Turns read back from what :func:`turn_template` wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass
class Rendered:
    text: str = ""
    #: Per turn: where its part of the output starts and stops.
    spans: list[tuple[int, int]] = field(default_factory=list)
    #: Per turn: where its content starts and stops.
    content: list[tuple[int, int]] = field(default_factory=list)
    #: Turns at which the template changed earlier output, and from where on.
    rewrites: list[tuple[int, int]] = field(default_factory=list)


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def render_incrementally(turns: list[Turn], template: Template) -> Rendered:
    """Render every prefix of ``turns`` and locate each turn in the output."""
    out = Rendered()
    before = template([])
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        start = len(before)
        if not now.startswith(before):
            start = _common(before, now)
            out.rewrites.append((k, start))
            # spans found so far end at the change
            out.spans = [(min(a, start), min(b, start)) for a, b in out.spans]
            out.content = [(min(a, start), min(b, start)) for a, b in out.content]
        shown, at = turns[:k], 0
        if not out.rewrites and k > 1:
            base = template(turns[k - 1 : k])
            alone = template(turns[k - 1 : k + 1])
            if alone.startswith(base) and alone[len(base) :] == now[start:]:
                shown, at = turns[k - 1 : k], start - len(base)
        head = at + _common(template([*shown, (role, "x")]), template([*shown, (role, "y")]))
        length = len(now) - at - len(template([*shown, (role, "")]))
        out.spans.append((start, len(now)))
        out.content.append((min(head, len(now)), max(head, min(head + length, len(now)))))
        before = now
    out.text = before
    return out


_FORMATTED = "conv_id long, formatted string, spans array<struct<start:long,stop:long>>, loss_mask array<struct<start:long,stop:long>>, rewrites array<struct<turn:long,start:long>>"


def _formatter(template: Template, loss_roles: tuple[str, ...]):
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    rewrite = pa.list_(pa.struct([("turn", pa.int64()), ("start", pa.int64())]))

    def one(conv: int | None, turns: list[Turn]) -> tuple:
        r = render_incrementally(turns, template)
        mask = [{"start": a, "stop": b} for (a, b), (role, _) in zip(r.content, turns, strict=True) if role in loss_roles and b > a]
        return conv, r.text, [{"start": a, "stop": b} for a, b in r.spans], mask, [{"turn": k, "start": a} for k, a in r.rewrites]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), span, span, rewrite]
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "formatted", "spans", "loss_mask", "rewrites"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, turns, done, held = none, [], [], 0
        for b in batches:
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv or conv is none:
                    if conv is not none:
                        done.append(one(conv, turns))
                        held += len(done[-1][1])
                        if held >= FLUSH:
                            yield batch(done)
                            done, held = [], 0
                    conv, turns = c, []
                turns.append((role or "", text or ""))
        if conv is not none:
            done.append(one(conv, turns))
        if done:
            yield batch(done)

    return run


def format_conversations(rows: DataFrame, template: Template = turn_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conv_id: formatted, spans, loss_mask, rewrites.

    ``rows`` has conv_id, turn, role, text. Conversations are dealt by id and
    sorted inside the partitions, then streamed: a worker holds one at a time.
    """
    prepare(rows.sparkSession)
    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_formatter(template, loss_roles), _FORMATTED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        rows = []
        for conv, text, mask in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[x["start"] : x["stop"]]) for x in mask)
            rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from :func:`format_conversations` with its template."""
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
