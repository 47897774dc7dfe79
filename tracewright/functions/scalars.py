"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Messages that alone make no session.
NOISE = ("invalid api key", "please run /login", "authentication failed", "unauthorized", "session expired", "rate limit", "api error", "warmup")
#: Word lists and phrases of the content checks.
POSITIVE = ("good", "great", "excellent", "amazing", "wonderful", "fantastic", "love", "happy", "joy", "beautiful", "awesome", "perfect", "best", "nice", "cool")
NEGATIVE = ("bad", "terrible", "awful", "horrible", "hate", "worst", "ugly", "stupid", "boring", "disgusting", "annoying", "useless", "pathetic", "ridiculous")
PROFANE = ("damn", "hell", "crap", "stupid", "idiot", "hate", "kill", "die", "death")
VIOLENT = ("kill", "murder", "weapon", "gun", "knife", "bomb", "operation", "violence", "fight", "hurt", "harm", "destroy", "threat", "dangerous")
HARASSING = ("loser", "freak", "weirdo", "ugly", "fat", "stupid", "retard", "shut up", "go away", "nobody likes", "everyone hates", "pathetic")
SPAM = ("click here", "free money", "limited time", "act now", "guaranteed", "no risk", "winner", "congratulations", "urgent", "immediate", "offer expires")


def truncate_middle(text: Column, most: int = 1000, edge: int = 400) -> Column:
    """The text, or where it is longer than most its first and last edge characters around a note of how many are left out."""
    n = F.length(text)
    cut = F.concat(F.substring(text, 1, edge), F.lit("... [truncated "), (n - 2 * edge).cast("string"), F.lit(" chars] ..."), F.right(text, F.lit(edge)))
    return F.when(n <= most, text).otherwise(cut)


def truncate_end(text: Column, most: int = 10000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def normal_timestamp(raw: Column) -> Column:
    """A timestamp from a string: ISO (no zone: UTC), or epoch seconds, or milliseconds from 10 ** 12 on; else null."""
    number = raw.try_cast("double")
    seconds = F.when(F.abs(number) > 1e12, number / 1000).otherwise(number)
    return F.when(number.isNotNull(), F.timestamp_micros((seconds * 1000000).cast("long"))).otherwise(F.try_to_timestamp(raw))


def clean_id(raw: Column) -> Column:
    """A name that is safe for a file: unsafe characters and blanks become one underscore, none at the ends, 200 at most."""
    safe = F.regexp_replace(F.regexp_replace(raw, r"""[<>:"/\\|?*\s'`&;]""", "_"), "_+", "_")
    return F.substring(F.regexp_replace(safe, "^_+|_+$", ""), 1, 200)


def is_safe_id(raw: Column) -> Column:
    return raw.rlike("^[A-Za-z0-9][A-Za-z0-9_.-]*$") & ~F.contains(raw, F.lit(".."))


def squeezed(text: Column) -> Column:
    """Escaped and real line breaks and runs of blanks as one blank."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\\n"), F.lit(" ")), r"\s+", " "))


def mcp_parts(name: Column) -> Column:
    """struct(server, tool) of mcp__server__tool, null for any other name."""
    parts = F.split(name, "__")
    return F.when((F.size(parts) >= 3) & (parts[0] == "mcp"), F.struct(parts[1].alias("server"), F.array_join(F.slice(parts, 3, 100), "__").alias("tool")))


def meaningful(n_messages: Column, has_tools: Column, first_content: Column) -> Column:
    """At least two messages, or one with tools, or one of over 5 characters that is no known noise."""
    content = F.trim(F.coalesce(first_content, F.lit("")))
    noise = F.lit(False)
    for phrase in NOISE:
        noise = noise | F.contains(F.lower(content), F.lit(phrase))
    return (n_messages >= 2) | ((n_messages == 1) & (has_tools | ((F.length(content) > 5) & ~noise)))


def event_uuid(host: Column, user: Column, iso_time: Column, source: Column, session: Column, n_messages: Column, n_tools: Column, summary: Column) -> Column:
    """sha256 over the fields joined by bars; missing host and user have stated names."""
    parts = [F.coalesce(host, F.lit("unknown_device")), F.coalesce(user, F.lit("unknown_user")), iso_time, F.lit("llm_interaction"), source, session, n_messages.cast("string"), n_tools.cast("string"), F.coalesce(summary, F.lit(""))]
    return F.sha2(F.concat_ws("|", *parts), 256)


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1000000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The square of half the chord on the unit sphere; of opposite points rounding may leave a little over 1."""
    return F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return arc_km(haversine(lat1, lon1, lat2, lon2))


def arc_km(a: Column) -> Column:
    """Kilometres along the great circle of a haversine."""
    return 6371.0 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(F.radians(lat2)), F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    """One of 16 points."""
    points = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
    return F.get(F.array(*map(F.lit, points)), F.pmod(F.round(degrees / 22.5).cast("int"), F.lit(16)))


def password_strength(p: Column, known_bad: tuple[str, ...] = ()) -> Column:
    """0 to 100: length, kinds of characters, distinct ones; less for known passwords and, by 25 at most, for runs of
    ascending characters."""
    n = F.length(p)
    kinds = sum((F.when(p.rlike(x), 10).otherwise(0) for x in (r"\p{Ll}", r"\p{Lu}", r"\d", r"[!@#$%^&*()_+\-=\[\]{}|;:,.<>?]")), F.lit(0))
    code = lambda i: F.ascii(F.substring(p, i, F.lit(1)))
    places = F.when(n >= 3, F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    runs = F.size(F.filter(places, lambda i: (code(i + 1) == code(i) + 1) & (code(i + 2) == code(i) + 2)))
    score = F.when(n >= 8, F.least(2 * n, F.lit(25))).otherwise(0) + kinds + F.least(2 * F.size(F.array_distinct(F.filter(F.split(p, ""), lambda c: c != ""))), F.lit(20)) - F.least(10 * runs, F.lit(25))
    score = score - (F.when(F.lower(p).isin(*known_bad), 30).otherwise(0) if known_bad else 0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def sentiment(text: Column) -> Column:
    """struct(n_words, positive, negative, spam, score, sentiment) by the word lists."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    within = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    spam = sum((F.contains(F.lower(text), F.lit(x)).cast("int") for x in SPAM), F.lit(0))
    score = (within(POSITIVE) - within(NEGATIVE)) / F.greatest(F.size(words), F.lit(1))
    return F.struct(F.size(words).alias("n_words"), within(POSITIVE).alias("positive"), within(NEGATIVE).alias("negative"), spam.alias("spam"), score.alias("score"), F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral").alias("sentiment"))


def moderation(text: Column, strict: bool = False) -> Column:
    """struct(profanity, violence, harassment, spam, categories, safety_score, safety_level) of a text.

    Profane words are counted as often as they occur; of the other lists each entry counts once, wherever the text contains it.
    The score is 1 less ten times what is flagged for each word, 0 at least; a null or blank text is safe. strict asks for a review
    below 0.9 and calls unsafe what is below 0.6."""
    low = F.lower(F.coalesce(text, F.lit("")))
    said = F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))
    once = lambda listed: sum((F.contains(low, F.lit(x)).cast("int") for x in listed), F.lit(0))
    profane = F.size(F.filter(said, lambda w: w.isin(*PROFANE)))
    counts = F.struct(profane.alias("profanity"), once(VIOLENT).alias("violence"), once(HARASSING).alias("harassment"), once(SPAM).alias("spam"), F.size(said).alias("n"))

    def judged(c: Column) -> Column:
        flagged = c["profanity"] + c["violence"] + c["harassment"] + c["spam"]
        score = F.greatest(F.lit(0.0), 1 - flagged / F.greatest(c["n"], F.lit(1)) * 10)
        level = F.when(score >= 0.8, "safe").when(score >= 0.5, "review_needed").when(score >= 0.2, "unsafe").otherwise("blocked")
        level = F.when(score < 0.6, "unsafe").when(score < 0.9, "review_needed").otherwise(level) if strict else level
        kinds = ("profanity", "violence", "harassment", "spam")
        categories = F.filter(F.array(*[F.when(c[k] > 0, k) for k in kinds]), lambda k: k.isNotNull())
        return F.struct(*[c[k].alias(k) for k in kinds], categories.alias("categories"), score.alias("safety_score"), level.alias("safety_level"))

    return F.get(F.transform(F.array(counts), judged), F.lit(0))
