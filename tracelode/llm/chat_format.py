"""Chat formatting by a declarative template and a finite-state machine.

Only DataFrame functions are used. Turn order is validated row by row: the
machine's state before a turn is the role of the turn before, so the first
forbidden transition is found with ``lag`` and no conversation is ever gathered
to be validated. Segments stay one row per piece of text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Candidates for the sign that starts an escape; the first that no marker holds.
_SIGNS = "\\\x1b\x1a^~`"


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, transitions (state to the roles that may follow), final states and roles with loss.

    Markers are any strings without line breaks, as long as the opening one can
    only be read where it was written: neither may hold it, nor may the end of one
    turn and the start of the closing marker spell it.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    start: str = "(start)"
    follows: dict = field(default_factory=lambda: {"(start)": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("assistant",)
    loss: tuple = ("assistant",)

    def __post_init__(self):
        told = self.open + self.close
        if not self.open or not self.close or "\n" in told or not set(_SIGNS) - set(told):
            raise ValueError("markers are strings without line breaks that leave an escape sign free")
        if self.open in self.close or self.open in (self.open + self.open)[1:-1] or f"{self.close}\n".startswith(self.open[1:]) and len(self.open) > 1:
            raise ValueError("the opening marker could be read where it was not written")


TEMPLATE = ChatTemplate()

def escapes(template: ChatTemplate, role: bool = False) -> list[tuple[str, str]]:
    """Replacements, in order, after which no marker can occur in a text: the escape sign itself, then what markers
    start with (two characters, or a marker of one); in roles line breaks, too. Undoing them in reverse is exact."""
    sign = next(c for c in _SIGNS if c not in template.open + template.close)
    starts = dict.fromkeys(m[:2] for m in (template.open, template.close))
    out = [(sign, f"{sign}0")]
    out += [(x, f"{x[:-1] if len(x) == 2 else ''}{sign}{code}") for x, code in zip(starts, (1, 3), strict=False)]
    return [*out, ("\n", f"{sign}2")] if role else out


def escape(text: Column, role: bool = False, template: ChatTemplate = TEMPLATE) -> Column:
    """Text in which no control string can occur; ``unescape`` restores it exactly."""
    for plain, coded in escapes(template, role):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, role: bool = False, template: ChatTemplate = TEMPLATE) -> Column:
    for plain, coded in reversed(escapes(template, role)):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_segments(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """One row per segment: ``conv_id, seq, part, segment, begin, loss, ok``.

    ``seq`` orders segments within the conversation (three a turn: header, body,
    end), ``begin`` is its first character in the conversation's output, ``loss`` is set on bodies of loss roles, ``ok`` tells whether the
    turn's role may follow the state before it. Turns are ordered by ``turn``
    (null first); ties by role, then text, so that reruns agree; repeated rows
    are turns of their own. Null text and role are empty; rows with null
    ``conv_id`` are one conversation; an empty table has no segments. Extra
    columns are dropped.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"n": F.row_number().over(order), "before": F.coalesce(F.lag("role").over(order), F.lit(template.start))})
    allowed = F.lit(False)
    for state, roles in template.follows.items():
        allowed = allowed | ((F.col("before") == state) & F.col("role").isin(*roles))
    end = template.close + "\n"
    t = t.select("conv_id", "n", "role", "turn", "text", allowed.alias("ok"), F.concat(F.lit(template.open), escape(F.col("role"), True, template), F.lit("\n")).alias("head"), escape(F.col("text"), False, template).alias("body"))
    size = F.length("head") + F.length("body") + len(end)
    t = t.withColumn("at", (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size).cast("long"))
    part = lambda i, text, at, loss: F.struct(F.lit(i).alias("part"), text.alias("segment"), at.cast("long").alias("begin"), loss.alias("loss"))
    parts = F.array(
        part(0, F.col("head"), F.col("at"), F.lit(False)),
        part(1, F.col("body"), F.col("at") + F.length("head"), F.col("role").isin(*template.loss)),
        part(2, F.lit(end), F.col("at") + F.length("head") + F.length("body"), F.lit(False)),
    )
    rows = t.select("conv_id", "n", "ok", F.explode(parts).alias("p"))
    return rows.select("conv_id", ((F.col("n").cast("long") - 1) * 3 + F.col("p.part")).alias("seq"), "p.part", "p.segment", "p.begin", "p.loss", "ok")


def validate(turns: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """``conv_id, n_turns, first_bad`` (0-based turn, null if none) and ``valid`` (ends in a final state, too)."""
    s = format_segments(turns, template).where("part = 0")
    role = unescape(F.substring(F.col("segment"), len(template.open) + 1, F.length("segment") - len(template.open) - 1), True, template)
    last = F.max_by(role, "seq")
    bad = F.min(F.when(~F.col("ok"), F.expr("seq div 3")))
    return s.groupBy("conv_id").agg(F.count("*").alias("n_turns"), bad.alias("first_bad"), (bad.isNull() & last.isin(*template.final)).alias("valid"))


def assemble(segments: DataFrame) -> DataFrame:
    """``conv_id, formatted``, its loss mask ``spans`` (``begin, size`` in characters, in order) and ``order_ok``, one row per conversation.

    ``order_ok`` is about transitions; whether the last state is a final one is
    for ``validate`` to say. A conversation's output is one string, so it is the
    unit that has to fit into a task's memory.
    """
    got = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "segment", "begin", "loss", "ok"))).alias("s"))
    mask = F.transform(F.filter("s", lambda x: x["loss"]), lambda x: F.struct(x["begin"].alias("begin"), F.length(x["segment"]).alias("size")))
    return got.select("conv_id", F.array_join(F.col("s.segment"), "").alias("formatted"), mask.alias("spans"), F.forall("s", lambda x: x["ok"]).alias("order_ok"))


def read_back(formatted: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Parses ``formatted`` again: ``conv_id, turns`` (role, text), ``loss_text`` (what lies under the mask), ``formatted_chars, order_ok``."""
    quoted = "".join(c if c.isalnum() or c.isspace() else f"\\{c}" for c in template.open)
    pieces = F.slice(F.split("formatted", quoted), 2, 1 << 30)
    end = len(template.close) + 1

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(1), cut - 1)
        text = F.substring(piece, cut + 1, F.length(piece) - cut - end)
        return F.struct(unescape(role, True, template).alias("role"), unescape(text, False, template).alias("text"))

    under = F.transform("spans", lambda x: F.substring(F.col("formatted"), (x["begin"] + 1).cast("int"), x["size"]))
    said = F.array_join(F.transform(under, lambda x: unescape(x, False, template)), "")
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), said.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"), "order_ok")
