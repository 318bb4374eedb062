"""Secret scans: patterns of known kinds, and the Shannon entropy of a window that slides over candidate strings.

All of it is DataFrame expressions. The pattern kinds give the *base* spans. The method adds spans: in every run of characters of one
class (hexadecimal, base 64) a window of fixed length moves one character at a time; a run that is a little shorter is one window. For window length W the entropy is
``log2(W) - sum(c * log2(c)) / W`` over the counts c of its characters, and a step changes the counts of two characters only: the one
that leaves and the one that enters. Windows at or over the threshold of their class are joined to spans. A run is suppressed when an
allow-list pattern describes all of it (plain words, plain numbers, UUIDs), and a span inside a base span is not reported again.

Positions are code points, ends exclusive. Where a pattern matches is found from the text between its matches.

Defined results: a null or empty text has no spans; rows with equal text get equal results, row by row; ids may be null or repeated.
Only the id and the results come back, so other columns cannot clash. ``redact`` returns null for a null text.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class Kind(NamedTuple):
    """A pattern whose matches are kept when their ``group`` has ``least`` characters."""

    name: str
    pattern: str
    group: int
    least: int


class Dense(NamedTuple):
    """A character class, the length of its window, the entropy in bits from which a window counts, and the shortest run that is judged.

    A run shorter than the window is one window of its own length. What its entropy may lack of the highest possible shrinks with the
    length: ``(log2(window) - bits) * length / window`` bits.
    """

    name: str
    characters: str
    window: int
    bits: float
    least: int


KINDS = (
    Kind("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
)
DENSE = (Dense("dense_hex", "0-9a-fA-F", 24, 3.05, 16), Dense("dense_base64", "A-Za-z0-9+/_=-", 24, 3.95, 16))
# Values that are copied at a time when running sums are gathered.
COPIED = 128
ALLOWED = (
    "[A-Za-z_/=+-]+",
    "[0-9_/=+-]+",
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
)


def _running(values: Column, kind: str, zero: Column, join) -> Column:
    """What ``join`` makes of all values before each, over an array, in blocks: a block's results are gathered by copying, so blocks are
    short, and the blocks' own results are carried on from block to block."""
    none = F.array().cast(f"array<{kind}>")

    def gathered(of: Column, start: Column) -> Column:
        step = lambda state, x: F.struct(join(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        return F.aggregate(of, F.struct(start.alias("at"), none.alias("out")), step)

    number = F.ceil(F.size(values) / F.lit(COPIED)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(number, F.lit(1)) - 1), lambda i: gathered(F.slice(values, i * COPIED + 1, COPIED), zero))
    carried = F.aggregate(
        blocks, F.struct(zero.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")),
        lambda state, block: F.struct(
            join(state["at"], block["at"]).alias("at"),
            F.concat(state["out"], F.array(F.transform(block["out"], lambda x: join(state["at"], x)))).alias("out"),
        ),
    )["out"]
    return F.when(F.size(values) <= COPIED, gathered(values, zero)["out"]).otherwise(F.flatten(carried))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost, non-overlapping matches of ``pattern``."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
        steps = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("match")), lambda x: F.struct(x["gap"].alias("gap"), F.length(x["match"]).alias("own"), x["match"].alias("match")))

        def ends(steps: Column) -> Column:
            before = _running(F.transform(steps, lambda x: x["gap"] + x["own"]), "int", F.lit(0), lambda a, b: a + b)
            return F.transform(
                F.arrays_zip(steps.alias("step"), before.alias("before")),
                lambda x: F.struct((x["before"] + x["step"]["gap"]).alias("start"), (x["before"] + x["step"]["gap"] + x["step"]["own"]).alias("end"), x["step"]["match"].alias("match")),
            )

        return _once(steps, ends)

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(matches: Column, order: int, name: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(name).alias("kind")))


def kind_spans(text: Column, kind: Kind, order: int) -> Column:
    matches = located(text, kind.pattern)
    if kind.group:
        long = lambda m: F.length(F.regexp_extract(m["match"], kind.pattern, kind.group)) >= kind.least
    else:
        long = lambda m: F.length(m["match"]) >= kind.least
    return _spans(F.filter(matches, long), order, kind.name)


def candidates(text: Column, dense: Dense) -> Column:
    """Runs of the class that are long enough and that no allow-list pattern describes, with their characters as an array."""
    runs = located(text, f"[{dense.characters}]{{{dense.least},}}")
    told = F.filter(runs, lambda m: ~m["match"].rlike("^(?:" + "|".join(ALLOWED) + r")\z"))
    return F.transform(told, lambda m: F.struct(m["start"].alias("start"), F.split(m["match"], "").alias("chars")))


def dense_spans(found: Column, dense: Dense, order: int) -> Column:
    """Spans of windows that reach the threshold, for the result of ``candidates``."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(dense.window + 1)])
    none = F.array().cast("array<struct<start:int,end:int>>")
    lack = (math.log2(dense.window) - dense.bits) / dense.window

    def count(part: Column, char: Column) -> Column:
        return F.size(part) - F.size(F.array_remove(part, char))

    def slide(run: Column) -> Column:
        chars = run["chars"]
        width = F.least(F.size(chars), F.lit(dense.window))
        least = width * width * lack  # of the sum over counts, a window at the threshold has this

        def leave(state: Column, i: Column) -> Column:
            """The sum after the character before the window has gone; i counts the characters that were in."""
            gone = F.element_at(chars, i - width + 1)
            before = count(F.slice(chars, i - width + 1, width), gone)
            return F.when(i >= width, state["sum"] - F.element_at(weight, before + 1) + F.element_at(weight, before)).otherwise(state["sum"])

        def step(state: Column, i: Column) -> Column:
            enters = F.element_at(chars, i + 1)
            kept = F.slice(chars, F.greatest(i - width + 2, F.lit(1)), F.least(i, width - 1))
            before = count(kept, enters)
            total = leave(state, i) - F.element_at(weight, before + 1) + F.element_at(weight, before + 2)
            start, end = run["start"] + i - width + 1, run["start"] + i + 1
            last = F.element_at(state["out"], -1)
            joins = (F.size(state["out"]) > 0) & (F.try_element_at(state["out"], F.lit(-1))["end"] >= start)
            grown = F.when(
                joins,
                F.concat(
                    F.slice(state["out"], 1, F.size(state["out"]) - 1),
                    F.array(F.struct(last["start"].alias("start"), end.alias("end"))),
                ),
            ).otherwise(F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end")))))
            # The sum is exact to far less than this; thresholds lie between the values that windows can have.
            out = F.when((i + 1 >= width) & (total <= least + 1e-9), grown).otherwise(state["out"])
            return F.struct(total.alias("sum"), out.alias("out"))

        start = F.struct(F.lit(0.0).alias("sum"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda s: s["out"])

    spans = F.flatten(F.transform(found, slide))
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(dense.name).alias("kind")))


def _outside(spans: Column, base: Column) -> Column:
    """The spans that no base span holds: none that starts before or with it ends with or after it."""
    marked = lambda of, new: F.transform(of, lambda s: F.struct(s["start"].alias("start"), F.lit(new).alias("new"), s["end"].alias("end"), s["order"].alias("order"), s["kind"].alias("kind")))

    def judged(both: Column) -> Column:
        # Sorted, base spans come before others of equal start.
        reached = _running(F.transform(both, lambda s: F.when(s["new"], F.lit(-1)).otherwise(s["end"])), "int", F.lit(-1), F.greatest)
        kept = F.filter(F.arrays_zip(both.alias("span"), reached.alias("reached")), lambda x: x["span"]["new"] & (x["reached"] < x["span"]["end"]))
        return F.transform(kept, lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["order"].alias("order"), x["span"]["end"].alias("end"), x["span"]["kind"].alias("kind")))

    found = _once(F.array_sort(F.concat(marked(base, False), marked(spans, True))), judged)
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), found).otherwise(spans)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the column ``_found``: base spans per kind, all base spans, all spans, each in order."""
    kinds = [kind_spans(F.col("_text"), kind, n) for n, kind in enumerate(KINDS)]
    docs = docs.select("*", F.coalesce(text, F.lit("")).alias("_text"))
    docs = docs.select("*", F.array(*kinds).alias("_kinds"), *[candidates(F.col("_text"), d).alias(f"_{d.name}") for d in DENSE]).drop("_text")
    docs = docs.select("*", F.array_sort(F.flatten("_kinds")).alias("_base"), F.flatten(F.array(*[dense_spans(F.col(f"_{d.name}"), d, len(KINDS) + n) for n, d in enumerate(DENSE)])).alias("_dense"))
    new = _outside(F.col("_dense"), F.col("_base"))
    found = F.struct(
        *[F.size(F.col("_kinds")[n]).cast("long").alias(f"n_{kind.name}") for n, kind in enumerate(KINDS)],
        F.col("_base").alias("base"), F.array_sort(F.concat("_base", new)).alias("spans"),
    )
    return docs.select(*[c for c in docs.columns if c not in {"_kinds", "_base", "_dense", *(f"_{d.name}" for d in DENSE)}], found.alias("_found"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, matches per kind, digest of the base spans and all spans as text, one row per row of ``docs``."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_read"))
    found = with_spans(rows, F.col("_read"))
    return found.select(
        id_col,
        *[F.col(f"_found.n_{kind.name}").alias(f"n_{kind.name}") for kind in KINDS],
        F.sha2(as_text(F.col("_found.base")).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("_found.spans")).alias("spans"),
    )


def redact(docs: DataFrame, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans by one."""
    rows = docs.select(F.struct(*[docs[c].alias(str(i)) for i, c in enumerate(docs.columns)]).alias("_row"), F.col(text_col).alias("_read"))
    marked = with_spans(rows, F.col("_read"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(state: Column, s: Column) -> Column:
        fresh = F.concat(state["parts"], F.array(F.substring(F.col("_read"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), F.lit(mark)))
        parts = F.when((s["start"] < state["at"]), state["parts"]).otherwise(fresh)
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), parts.alias("parts"))

    whole = F.aggregate("_found.spans", empty, cut, lambda s: F.concat(F.array_join(s["parts"], ""), F.col("_read").substr(s["at"] + F.lit(1), F.length("_read"))))
    text = F.when(F.size("_found.spans") > 0, whole).otherwise(F.col("_read"))
    return marked.select(*[(text if c == text_col else F.col("_row").getField(str(i))).alias(c) for i, c in enumerate(docs.columns)])
