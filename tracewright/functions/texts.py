"""Texts by word lists, shapes and counts, as Column expressions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of emotions; the first of the most frequent ones wins.
EMOTIONS = {
    "joy": ("happy", "joy", "excited", "cheerful", "delighted", "thrilled"),
    "anger": ("angry", "mad", "furious", "annoyed", "irritated", "rage"),
    "fear": ("afraid", "scared", "terrified", "worried", "anxious", "nervous"),
    "sadness": ("sad", "depressed", "miserable", "unhappy", "crying", "tears"),
}
#: Keywords that add a path to a program.
BRANCHES = ("if", "elif", "for", "while", "except", "and", "or")


def transformed(text: Column, kind: str) -> Column:
    """uppercase, lowercase, title_case (a letter after none is upper), sentence_case, reverse or remove_punctuation."""
    lower = F.lower(text)
    if kind == "title_case":
        # alternating runs of letters and of others
        runs = F.regexp_extract_all(lower, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
        return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")
    kinds = {
        "uppercase": F.upper(text),
        "lowercase": lower,
        "sentence_case": F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30))),
        "reverse": F.reverse(text),
        "remove_punctuation": F.translate(text, PUNCTUATION, ""),
    }
    return kinds[kind]


def _within(listed: tuple[str, ...], word: Column) -> Column:
    return word.isin(*listed)


def votes(text: Column, lists: dict[str, tuple[str, ...]] = EMOTIONS, none: str = "neutral") -> Column:
    """struct of a count per list, and best: the first list with the most words, or `none` without any; a null text has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    listed = F.filter(words, partial(_within, tuple(w for words_of in lists.values() for w in words_of)))
    counts = F.transform(F.array(listed), lambda w: F.array(*[F.size(F.filter(w, partial(_within, words_of))) for words_of in lists.values()]))
    named = lambda n: F.when(F.array_max(n) > 0, F.element_at(F.array(*map(F.lit, lists)), F.array_position(n, F.array_max(n)).cast("int"))).otherwise(none)
    each = lambda n: F.struct(*[F.get(n, F.lit(k)).alias(name) for k, name in enumerate(lists)], named(n).alias("best"))
    return F.get(F.transform(counts, each), F.lit(0))


def classified(text: Column, types: dict[str, tuple[tuple[str, ...], float]]) -> Column:
    """struct(type, score, meets): the first type with the greatest share of its fields in the text, in any case, and whether
    that reaches the type's own threshold."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    share = lambda fields: sum((F.contains(lower, F.lit(f.lower())).cast("int") for f in fields), F.lit(0)) / len(fields)
    scores = F.array(*[F.struct(share(fields).alias("score"), F.lit(-k).alias("__k"), F.lit(name).alias("type"), F.lit(least).alias("least")) for k, (name, (fields, least)) in enumerate(types.items())])
    best = F.transform(F.array(F.array_max(scores)), lambda b: F.struct(b["type"].alias("type"), b["score"].alias("score"), (b["score"] >= b["least"]).alias("meets")))
    return F.get(best, F.lit(0))


def complexity(code: Column, issues: Column) -> Column:
    """struct(n_lines, logical, comments, blank, complexity, maintainability): the index starts at 171 and loses 5.2 times
    branches a line, 0.23 a branch and 16.2 times issues a line, within 0 and 100; 100 without logical lines."""
    bare = F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"\A\s+", ""))
    counts = F.struct(
        F.size(bare).alias("n"),
        F.size(F.filter(bare, lambda x: x != "")).alias("logical"),
        F.size(F.filter(bare, lambda x: x.startswith("#"))).alias("comments"),
        (F.regexp_count(code, F.lit(rf"\b({'|'.join(BRANCHES)})\b")) + 1).alias("paths"),
        issues.alias("issues"),
    )

    def measured(c: Column) -> Column:
        index = 171 - 5.2 * (c["paths"] / c["logical"]) - 0.23 * c["paths"] - 16.2 * (c["issues"] / c["logical"])
        held = F.when(c["logical"] == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)))
        return F.struct(c["n"].alias("n_lines"), c["logical"].alias("logical"), c["comments"].alias("comments"), (c["n"] - c["logical"]).alias("blank"), c["paths"].alias("complexity"), held.alias("maintainability"))

    return F.get(F.transform(F.array(counts), measured), F.lit(0))


def utc_offset(longitude: Column) -> Column:
    """Hours from UTC by the longitude: a fifteenth of it, a half to the even hour, within -12 and 14."""
    return F.greatest(F.lit(-12), F.least(F.lit(14), F.bround(longitude / 15).cast("int")))


def event_line(source: Column, ts: Column, session: Column, n_turns: Column, n_tools: Column) -> Column:
    """One line on a session: source, time, the start of what follows the last underscore of its id, turns and tools."""
    short = F.substring(F.substring_index(session, "_", -1), 1, 8)
    return F.concat(F.lit("["), F.upper(source), F.lit("] "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" | Session: "), short, F.lit("... | Turns: "), n_turns.cast("string"), F.lit(" | Tools: "), n_tools.cast("string"))
