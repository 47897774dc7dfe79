"""Nested values (variants) as tables of their nodes, and back: validation and pruning by a query's shape, sealing of leaves.

A query is itself a variant: an object asks for each of its keys, a list for a list whose items fit its first element, and anything
else, the name of a format, asks only that something is there. Nodes are found level by level, one lateral join each, so that any
depth is met without a Python worker; the number of levels is that of the deepest value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.containment import containing
from tracewright.operators.progress import running
from tracewright.operators.storage import kept

#: Fixed value: what a token begins with.
TOKEN = "#DATA"
PROMPT = "prompt"


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(value.isNotNull(), "leaf")


def nodes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, path, place, kind (object, array, leaf), value: every node of every value, the whole value with the empty path first.

    A step of a path is a key after a dot, or [] for any item of a list; place holds the node's position among its siblings at each
    step, objects in order of their keys, so that (place) orders nodes as they are met from the left. A null value has no nodes."""
    level = rows.select(F.col(key), F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"), F.col(value).alias("value"))
    level = kept(level.where(F.col("value").isNotNull()).withColumn("kind", _kind(F.col("value"))))
    out = level
    while not (nested := level.where("kind <> 'leaf'")).isEmpty():
        below = nested.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("__pos", "__key", "__value"))
        step = F.when(F.col("kind") == "array", "[]").otherwise(F.concat(F.lit("."), F.col("__key")))
        level = below.where(F.col("__value").isNotNull()).select(F.col(key), F.array_append("path", step).alias("path"), F.array_append("place", F.col("__pos")).alias("place"), F.col("__value").alias("value"))
        level = kept(level.withColumn("kind", _kind(F.col("value"))))
        out = out.unionByName(level)
    return out


def _parent(path: str = "path") -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def _asked(queries: DataFrame, query: str, value: str) -> DataFrame:
    """query, path, asks, form: the nodes of queries; of a list only the first element counts, what lies under others is dropped."""
    found = nodes(queries, query, value)
    in_first = F.forall(F.arrays_zip("path", "place"), lambda s: (s["path"] != "[]") | (s["place"] == 0))
    form = F.when(F.col("kind") == "leaf", F.try_variant_get("value", "$", "string"))
    return found.where(in_first).select(F.col(query), "path", F.col("kind").alias("asks"), form.alias("form"))


def validated(rows: DataFrame, key: str, value: str, query: str, queries: DataFrame, shape: str) -> DataFrame:
    """key, valid: whether each value fits the query that its row names (queries: query, shape).

    Relational division: at each node of the query the value must have the asked kind wherever it has that node at all, and must have
    it under each of its instances of the parent, when that is an object. What the query does not ask for is no fault, an empty list
    fits any list, and nothing below a leaf of the query is looked at. A null value, or a query that is not listed, does not fit. Keys
    should be unique."""
    asked = kept(_asked(queries, query, shape))
    found = kept(nodes(rows, key, value).join(rows.select(key, query), key))
    at = found.join(asked, [query, "path"])
    wrong = at.where((F.col("asks") != "leaf") & (F.col("asks") != F.col("kind"))).select(key).distinct()
    counts = at.groupBy(key, query, "path", "asks").agg(F.count("*").alias("n"))
    needed = asked.where((F.size("path") > 0) & F.element_at("path", -1).startswith(".")).select(F.col(query), F.col("path").alias("child"), _parent().alias("path"))
    parents = counts.where("asks = 'object'").join(needed, [query, "path"]).select(key, F.col("child").alias("path"), F.col("n").alias("needed"))
    short = parents.join(counts.select(key, "path", "n"), [key, "path"], "left").where(F.coalesce("n", F.lit(0)) < F.col("needed")).select(key).distinct()
    faults = wrong.unionByName(short).distinct().withColumn("__fault", F.lit(True))
    roots = found.where(F.size("path") == 0).join(asked.select(query).distinct(), query, "left_semi").select(key, F.lit(True).alias("__root"))
    return rows.select(key).join(roots, key, "left").join(faults, key, "left").select(key, (F.col("__root").isNotNull() & F.col("__fault").isNull()).alias("valid"))


def prompt_values(rows: DataFrame, key: str, value: str, query: str, queries: DataFrame, shape: str) -> DataFrame:
    """key, place, value (JSON): what stands, however nested, where the query says prompt; place gives their order in a row."""
    asked = _asked(queries, query, shape).where(F.col("form") == PROMPT)
    return nodes(rows, key, value).join(rows.select(key, query), key).join(asked.select(query, "path"), [query, "path"]).select(key, "place", F.to_json("value").alias("value"))


def _rebuilt(found: DataFrame, key: str) -> DataFrame:
    """key, value: nodes (key, path, place, kind, json of leaves) put together from the deepest level up; a container without
    children is empty. A container's children are those of one value, which was one row before."""
    deepest = found.agg(F.max(F.size("path"))).first()[0] or 0
    name = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    level = kept(found.where(F.size("path") == deepest).select(key, "path", "place", "kind", "json"))
    whole = F.coalesce("json", F.when(F.col("kind") == "object", "{}").otherwise("[]"))
    for depth in range(deepest - 1, -1, -1):
        level = level.withColumn("__text", whole).withColumn("__step", F.substr(F.element_at("path", -1), F.lit(2)))
        entry = F.struct(F.element_at("place", -1).alias("at"), F.when(F.element_at("path", -1) == "[]", F.col("__text")).otherwise(F.concat(name("__step"), F.lit(":"), "__text")).alias("text"))
        up = level.groupBy(key, F.slice("path", F.lit(1), F.lit(depth)).alias("path"), F.slice("place", F.lit(1), F.lit(depth)).alias("place"))
        up = up.agg(F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), ",").alias("__inner"))
        own = found.where(F.size("path") == depth).select(key, "path", "place", "kind", "json")
        joined = own.join(up, [key, "path", "place"], "left")
        made = F.when(F.col("kind") == "object", F.concat(F.lit("{"), "__inner", F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), "__inner", F.lit("]")))
        level = kept(joined.select(key, "path", "place", "kind", F.coalesce("json", made).alias("json")))
    return level.select(key, F.try_parse_json(whole).alias("value"))


def _shaped(rows: DataFrame, key: str, value: str, query: str, asked: DataFrame) -> DataFrame:
    """The nodes that a query asks for, with form at its leaves and json for what stands there, however nested."""
    at = nodes(rows, key, value).join(rows.select(key, query), key).join(asked, [query, "path"])
    return at.withColumn("json", F.when((F.col("asks") == "leaf") | (F.col("kind") == "leaf"), F.to_json("value")))


def pruned(rows: DataFrame, key: str, value: str, query: str, queries: DataFrame, shape: str) -> DataFrame:
    """key, value: the values without the keys that their query does not ask for. A value without nodes, or without a listed query, is
    left out."""
    return _rebuilt(_shaped(rows, key, value, query, kept(_asked(queries, query, shape))), key)


def sealed(rows: DataFrame, key: str, run: str, order: str, value: str, query: str, queries: DataFrame, shape: str) -> tuple[DataFrame, DataFrame]:
    """(key, run, value) with a token in the place of each leaf that the query does not mark as prompt, and the tokens: run, number,
    token, format, value (JSON of what it stands for), key.

    Numbers run from 0 in each run, by the rows' order (key where equal), then as leaves are met. They come from prefix sums over all
    rows: no task holds a whole run. What a query does not ask for goes; rows should be valid."""
    asked = kept(_asked(queries, query, shape))
    shaped = kept(_shaped(rows, key, value, query, asked).join(rows.select(key, run, order), key))
    to_seal = F.col("json").isNotNull() & (F.coalesce("form", F.lit("")) != PROMPT)
    leaves = shaped.where(to_seal).select(run, order, key, "place", "path", F.col("form").alias("format"), F.col("json").alias("__json"))
    numbered = kept(running(leaves, [run, order, key, "place"], {"__nth": F.lit(1)}))
    first = numbered.groupBy(run).agg(F.min("__nth").alias("__first"))
    tokens = numbered.join(first.withColumnRenamed(run, "__run"), F.col(run).eqNullSafe(F.col("__run"))).withColumn("number", F.col("__nth") - F.col("__first"))
    tokens = kept(tokens.withColumn("token", F.concat(F.lit(TOKEN), F.col("number").cast("string"))).select(run, "number", "token", "format", F.col("__json").alias("value"), key, "place", "path"))
    with_tokens = shaped.join(tokens.select(key, "path", "place", "token"), [key, "path", "place"], "left")
    text = F.coalesce(F.concat(F.lit('"'), "token", F.lit('"')), "json")
    built = _rebuilt(with_tokens.select(key, "path", "place", "kind", text.alias("json")), key)
    return built.join(rows.select(key, run), key).select(key, run, "value"), tokens.drop("place", "path")


def _as_text(json: Column) -> Column:
    """What a value looks like inside a longer string: strings as they are, others as JSON."""
    return F.coalesce(F.when(json.startswith('"'), F.try_variant_get(F.try_parse_json(json), "$", "string")), json)


def unsealed(rows: DataFrame, key: str, run: str, value: str, tokens: DataFrame) -> DataFrame:
    """key, run, value: the inverse. A leaf that is one token becomes the value it stands for, a token within a longer string its
    text. Tokens that the row's run does not have stay as they are, also those of other runs."""
    found = kept(nodes(rows, key, value).join(rows.select(key, run), key))
    leaves = found.where("kind = 'leaf'").withColumn("__text", F.try_variant_get("value", "$", "string"))
    said = leaves.where(F.contains("__text", F.lit(TOKEN)) & (F.schema_of_variant("value") == "STRING"))
    pieces = said.select(key, run, "path", "place", F.posexplode(F.regexp_extract_all("__text", F.lit(rf"{TOKEN}[0-9]+|(?s)(?:(?!{TOKEN}[0-9]).)+"), F.lit(0))).alias("__at", "__piece"))
    own = tokens.select(F.col(run).alias("__run"), F.col("token").alias("__token"), F.col("value").alias("__json"))
    met = pieces.join(own, (F.col("__piece") == F.col("__token")) & F.col(run).eqNullSafe(F.col("__run")), "left")
    entry = F.struct("__at", F.coalesce(_as_text(F.col("__json")), F.col("__piece")).alias("text"))
    joined = met.groupBy(key, "path", "place").agg(F.count("*").alias("__n"), F.max("__json").alias("__json"), F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), "").alias("__new"))
    quoted = F.expr("substring(to_json(array(__new)), 2, length(to_json(array(__new))) - 2)")
    alone = (F.col("__n") == 1) & F.col("__json").isNotNull()
    new = joined.select(key, "path", "place", F.when(alone, F.col("__json")).otherwise(quoted).alias("__new_json"))
    rows_json = found.join(new, [key, "path", "place"], "left").select(key, "path", "place", "kind", F.coalesce("__new_json", F.when(F.col("kind") == "leaf", F.to_json("value"))).alias("json"))
    return _rebuilt(rows_json, key).join(rows.select(key, run), key).select(key, run, "value")


def resealed(messages: DataFrame, key: str, run: str, text: str, tokens: DataFrame) -> DataFrame:
    """key, text: messages in which the string values of the run's tokens are replaced by their tokens, in one pass from the left, the
    longest value first where several begin; so neither a value inside another one nor a digit of a token is taken for one. Equal values
    take the first token, empty ones replace nothing. Only values that a message holds go with it. Keys should be unique."""
    values = tokens.where(F.col("value").startswith('"')).select(F.col(run).alias("__run"), _as_text(F.col("value")).alias("__v"), "number", "token").where("__v <> ''")
    first = values.groupBy("__run", "__v").agg(F.min_by("token", "number").alias("__t"))
    held = containing(messages, key, text, first, "__v").join(messages.select(key, run), key).where(F.col("__run").eqNullSafe(F.col(run)))
    own = held.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.length("__v")).alias("n"), F.col("__v").alias("v"), F.col("__t").alias("t")))).alias("__values"))
    literal = lambda v: F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    any_of = F.concat(F.lit(f"{TOKEN}[0-9]+|"), F.array_join(F.transform("__values", lambda x: literal(x["v"])), "|"))
    pieces = F.regexp_extract_all(text, F.concat(F.lit("(?s)"), any_of, F.lit("|(?:(?!"), any_of, F.lit(").)+")), F.lit(0))
    by_value = F.map_from_entries(F.transform("__values", lambda x: F.struct(x["v"], x["t"])))
    new = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(by_value, p), p)), "")
    return messages.join(own, key, "left").select(key, F.when(F.col("__values").isNull(), F.col(text)).otherwise(new).alias(text))
