"""Secret scans in DataFrame functions alone.

Base patterns (assignments, access keys, hex strings) are found whole by
splitting a text at their matches, which gives every match its place. Further
candidates are runs of token characters: a window slides over each, the
character counts are kept up to date as one character enters and one leaves,
and where the window's Shannon entropy reaches the threshold of the string's
character class, the run of such windows is a span. Strings of an allowed form
are left out. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import fresh_name, text_of

#: The base patterns, their group that is measured, and its least length. Access keys and hex strings
#: are asked for in their least length at once, which finds the same: a match runs to the end of its characters.
BASE = (
    (
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What a text must hold for a base pattern to be worth placing.
QUICK = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
ENTROPY = "entropy"
KINDS = [k for k, *_ in BASE] + [ENTROPY]
#: Characters in the sliding window, and the characters that a candidate is made of.
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % WINDOW
#: Character classes, the first that fits counts, with the entropy in bits from which a window is a secret.
CLASSES = (
    (r"^[0-9a-fA-F]+$", 3.0),
    (r"^[A-Z0-9]+$", 3.5),
    (r"^[a-z0-9]+$", 3.6),
    (r"", 3.8),
)
#: Letters that look like words: of one case, or capitalised parts. Possessive, so that long runs need no stack.
_WORDS = r"(?:[A-Z]?+[a-z]++(?:[A-Z][a-z]{2,}+)*+|[A-Z]++)"
#: Forms that are no secrets: words joined by marks, numbers and dates, UUIDs, words with a number at the end.
ALLOWED = (
    rf"^{_WORDS}(?:[+/_=-]++{_WORDS})*+[+/_=-]*+$",
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    rf"^[+/_=-]*+{_WORDS}(?:[+/_=-]++{_WORDS})*+[+/_=-]*+[0-9]{{1,4}}$",
)
REDACTED = "[redacted]"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


#: Matches that are placed together, so that adding one to a list copies a short one.
_TOGETHER = 256


def _placed(text: Column, pattern: str) -> Column:
    """Every match of ``pattern`` as (start, end, text), from the lengths of the pieces between matches.

    The starts are prefix sums in two levels, within blocks of matches and over blocks.
    """
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(
        F.slice(pieces, 1, F.size(found)),
        found,
        lambda n, m: F.struct(n.alias("gap"), F.length(m).alias("size"), m.alias("match")),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        one = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(some: Column, at: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])

    def all_blocks(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        starts = F.aggregate(
            lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
        )
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), block))

    def cut(matches: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(matches), F.lit(1)), F.lit(_TOGETHER))
        return F.transform(firsts, lambda k: F.slice(matches, k, F.lit(_TOGETHER)))

    # each step's list is used several times, so it is bound once
    return _bound(both, lambda matches: _bound(cut(matches), all_blocks))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _base(text: Column, place: int) -> Column:
    kind, pattern, group, least = BASE[place]
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    spans = F.zip_with(
        _placed(text, pattern),
        measured,
        lambda m, g: F.struct(
            m["start"].alias("start"), F.lit(place).alias("kind"), m["end"].alias("end"), F.length(g).alias("size")
        ),
    )
    kept = F.transform(
        F.filter(spans, lambda s: s["size"] >= least), lambda s: F.struct(s["start"], s["kind"], s["end"])
    )
    return F.when(text.rlike(QUICK[kind]), kept.cast(_SPAN)).otherwise(_none())


def _weight(count: Column) -> Column:
    """n log2 n, the part of a character that occurs n times in the window's entropy."""
    n = count.cast("double")
    return F.when(count > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def _high_entropy(candidate: Column) -> Column:
    """Runs of windows of one candidate whose entropy reaches its class's threshold, as (start, end) in it."""
    threshold = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        threshold = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(threshold)
    chars = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    chars = F.filter(chars, lambda c: c > 0)
    spans = "array<struct<start:int,end:int>>"
    begin = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.array().cast(spans).alias("out"),
    )

    def slide(state: Column) -> Column:
        chars, threshold = state["chars"], state["threshold"]

        def step(acc: Column, i: Column) -> Column:
            enters = F.element_at(chars, i + 1)
            leaves = F.when(i >= WINDOW, F.element_at(chars, F.greatest(i + 1 - WINDOW, F.lit(1)))).otherwise(F.lit(0))
            same = enters == leaves
            into = F.element_at(acc["counts"], enters)
            out_of = F.when(leaves > 0, F.element_at(acc["counts"], F.greatest(leaves, F.lit(1)))).otherwise(F.lit(0))
            change = (_weight(into + 1) - _weight(into)) + (_weight(F.greatest(out_of - 1, F.lit(0))) - _weight(out_of))
            counts = F.when(same, acc["counts"]).otherwise(
                F.transform(
                    acc["counts"],
                    lambda v, k: v + F.when(k + 1 == enters, 1).otherwise(0) - F.when(k + 1 == leaves, 1).otherwise(0),
                )
            )
            total = F.when(same, acc["sum"]).otherwise(acc["sum"] + change)
            hot = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= threshold)
            first = i + 1 - WINDOW
            last = F.element_at(acc["out"], -1)
            joins = (F.size(acc["out"]) > 0) & (F.coalesce(last["end"], F.lit(-1)) >= first)
            longer = F.concat(
                F.slice(acc["out"], 1, F.greatest(F.size(acc["out"]) - 1, F.lit(0))),
                F.array(F.struct(last["start"].alias("start"), (i + 1).alias("end"))),
            )
            added = F.concat(acc["out"], F.array(F.struct(first.alias("start"), (i + 1).alias("end"))))
            out = F.when(~hot, acc["out"]).when(joins, longer).otherwise(added)
            return F.struct(counts.alias("counts"), total.alias("sum"), out.cast(spans).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), begin, step, lambda acc: acc["out"])

    # the characters are looked up by each step, so they are bound once
    return _bound(F.struct(chars.alias("chars"), threshold.alias("threshold")), slide)


def _entropy_spans(text: Column) -> Column:
    allowed = F.lit(False)

    def is_allowed(s: Column) -> Column:
        out = allowed
        for form in ALLOWED:
            out = out | s.rlike(form)
        return out

    kept = F.filter(_placed(text, CANDIDATE), lambda c: ~is_allowed(c["match"]))
    spans = F.flatten(
        F.transform(
            kept,
            lambda c: F.transform(
                _high_entropy(c["match"]),
                lambda s: F.struct(
                    (c["start"] + s["start"]).alias("start"),
                    F.lit(len(BASE)).alias("kind"),
                    (c["start"] + s["end"]).alias("end"),
                ),
            ),
        )
    )
    return F.when(text.rlike(CANDIDATE), spans.cast(_SPAN)).otherwise(_none())


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> tuple[DataFrame, str]:
    """``docs`` with all secret spans, array<struct<start, kind, end>> by start and kind, and that column's name.

    ``kind`` is a place in ``KINDS``. Base spans are all kept; an entropy span
    inside a base span says nothing new and is left out. Null and empty texts
    have none; texts are read whole; rows and other columns stay; a clashing
    ``out`` gets underscores in front.
    """
    name = fresh_name(out, docs.columns)
    parts = [fresh_name(f"_{name}_{k}", docs.columns) for k in KINDS]
    text = text_of(text_col)
    found = docs.withColumns({p: _base(text, k) for k, p in enumerate(parts[:-1])} | {parts[-1]: _entropy_spans(text)})
    base = F.concat(*parts[:-1])
    added = F.when(
        F.size(parts[-1]) > 0,
        F.filter(parts[-1], lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))),
    ).otherwise(_none())
    return found.withColumn(name, F.array_sort(F.concat(base, added))).drop(*parts), name


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``REDACTED``.

    Overlapping spans are replaced as one. ``length_col``, where the table has
    it, follows the changed texts. Rows without secrets, null texts too, stay
    as they are; so do the columns.
    """
    marked, name = with_spans(docs, text_col)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        inside = (s["start"] < acc["at"]) & (F.size(acc["out"]) > 0)
        out = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept, F.lit(REDACTED))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(
        F.col(name),
        start,
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))),
    )
    has = F.size(name) > 0
    changed = {text_col: F.when(has, clean).otherwise(text)}
    result = marked.withColumns(changed)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        result = result.withColumn(length_col, F.when(has, F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return result.select(*docs.columns)
