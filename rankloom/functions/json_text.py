"""Parsing rankings out of model texts, and building prompts and rows of training text.

Three parsers exist because three consumers differ in what they forgive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "struct<rank:string,tariff_id:string>"
#: The identifiers after a "tariff_id" key, quoted or not: a fixed pattern.
ID_PATTERN = r'"tariff_id"\s*:\s*"?([\w:-]+)"?'


def _object(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def _ids(json: Column, field: str) -> Column:
    """Ids of a list of objects or plain values, in order; null if the field isn't a list of either."""
    raw = F.get_json_object(json, f"$.{field}")
    objects = F.from_json(raw, f"array<{ITEM}>")
    plain = F.from_json(raw, "array<string>")
    ids = F.filter(F.transform(objects, lambda x: x["tariff_id"]), lambda x: x.isNotNull())
    return F.when(F.size(ids) > 0, ids).when(raw.rlike(r"^\s*\[\s*[^{\s]"), plain)


def by_pattern(text: Column, k: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(ID_PATTERN), F.lit(1)), 1, k)


def parse_lenient(text: Column) -> Column:
    """Ranked ids, three at most: the JSON object in a text, else the pattern."""
    json = _object(text)
    fine = F.try_parse_json(json).isNotNull()
    found = F.coalesce(_ids(json, "top_3"), _ids(json, "recommendations"), F.array().cast("array<string>"))
    return F.slice(F.when(fine, found).otherwise(F.coalesce(by_pattern(text), F.array().cast("array<string>"))), 1, 3)


def parse_strict(text: Column) -> Column:
    """Struct of ids and strict: whether the text is exactly {"top_3": [three ranked ids]} and nothing else."""
    t = F.trim(text)
    value = F.try_parse_json(t)
    items = F.from_json(F.get_json_object(t, "$.top_3"), f"array<{ITEM}>")
    ids = F.transform(items, lambda x: x["tariff_id"])
    quoted = F.size(F.regexp_extract_all(t, F.lit(r'"tariff_id"\s*:\s*"'), F.lit(0))) == 3
    whole = F.size(F.regexp_extract_all(t, F.lit(r'"rank"\s*:\s*[123]\s*[,}]'), F.lit(0))) == 3
    keys = F.forall(F.from_json(F.get_json_object(t, "$.top_3"), "array<string>"), lambda x: F.array_sort(F.json_object_keys(x)) == F.array(F.lit("rank"), F.lit("tariff_id")))
    strict = (
        value.isNotNull()
        & (F.json_object_keys(t) == F.array(F.lit("top_3")))
        & (F.transform(items, lambda x: x["rank"]) == F.array(F.lit("1"), F.lit("2"), F.lit("3")))
        & (F.size(F.array_distinct(ids)) == 3)
        & quoted
        & whole
        & keys
    )
    return F.struct(F.when(F.coalesce(strict, F.lit(False)), ids).otherwise(parse_lenient(text)).alias("ids"), F.coalesce(strict, F.lit(False)).alias("strict"))


def parse_checked(text: Column, valid: Column) -> Column:
    """Struct of json (parses at all), valid (three distinct known ids) and ids."""
    json = F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))
    ids = F.coalesce(F.when(json, _ids(text, "top_3")), F.array().cast("array<string>"))
    fine = (F.size(ids) == 3) & (F.size(F.array_distinct(ids)) == 3) & (F.size(F.array_except(ids, valid)) == 0)
    return F.struct(json.alias("json"), fine.alias("valid"), ids.alias("ids"))


def ranking_json(ids: Column) -> Column:
    """The training target: {"top_3":[{"rank":1,"tariff_id":...}, ...]}; null unless there are three distinct ids."""
    items = F.transform(ids, lambda x, i: F.struct((i + 1).alias("rank"), x.alias("tariff_id")))
    fine = (F.size(ids) == 3) & (F.size(F.array_distinct(ids)) == 3)
    return F.when(fine, F.to_json(F.struct(items.alias("top_3"))))


def prompt_text(header: list[Column | str], options: Column, footer: str) -> Column:
    """Header lines, one line for each option, a blank line and the instruction."""
    head = [F.lit(h) if isinstance(h, str) else h for h in header]
    return F.concat_ws("\n", *head, F.array_join(options, "\n"), F.lit(""), F.lit(footer))


def option_line(x: Column, fields: list[str]) -> Column:
    """One option as JSON with spaced separators; numbers and strings only."""
    parts = [F.concat(F.lit(f'"{f}": '), F.to_json(F.array(x[f])).substr(F.lit(2), F.length(F.to_json(F.array(x[f]))) - 2)) for f in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def messages(df: DataFrame, by: str, turn: str, role: str, text: str) -> DataFrame:
    """by, messages: chat messages in order of turn."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(by).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def completion_text(plain: Column, message: Column, turns: Column) -> Column:
    """A completion as text: the string, a message's content, or the last turn's."""
    return F.coalesce(plain, message["content"], F.get(turns, F.size(turns) - 1)["content"], F.lit(""))


def output_text(output: Column) -> Column:
    """All output_text parts of all messages of a nested response, joined."""
    said = F.filter(output, lambda m: m["type"] == "message")
    parts = F.flatten(F.transform(said, lambda m: F.coalesce(m["content"], F.array())))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "output_text"), lambda p: p["text"]), "")


def token_estimate(text: Column, chars: int = 3) -> Column:
    return F.ceil(F.length(text) / chars)
