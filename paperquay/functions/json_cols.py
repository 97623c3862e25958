"""JSON text columns: tolerant parsing, answer maps, reply parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperquay.functions.text import let, strip

ANSWERS = "map<string,struct<answer:string,score:double>>"
COLUMNS = "array<struct<key:string,label:string,question:string>>"


def strict_json(c: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else; null otherwise.

    The parser stops after the first value, so the text is read as the only item of a list.
    """

    def only(items: Column) -> Column:
        return F.when(
            F.try_variant_get(items, "$[1]", "variant").isNull(), F.try_variant_get(items, "$[0]", "variant")
        )

    return let(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), only)


def json_or(c: Column, fallback: str) -> Column:
    """Variant of the JSON in ``c``; of ``fallback`` when it is missing or broken."""
    return F.coalesce(strict_json(c), F.parse_json(F.lit(fallback)))


def json_kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type name."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def list_length(c: Column) -> Column:
    return F.coalesce(F.json_array_length(F.when(c != "", c)), F.lit(0))


def answer_map(c: Column) -> Column:
    """Answers by key; null when the text is broken or holds none."""
    m = F.from_json(c, ANSWERS)
    return F.when(F.size(m) > 0, m)


def field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", "variant")


def scalar_answer(v: Column) -> Column:
    """struct(answer, score) of a reply value: text of the value, 1.0 when it is not empty or zero."""

    def body(x: Column) -> Column:
        kind, text = x["kind"], x["text"]
        answer = (
            F.when(text.isNull() | (kind == "VOID"), "").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
        )
        number = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), text.try_cast("double"))
        empty = (
            F.coalesce(text, F.lit("")).isin("")
            | ((kind == "BOOLEAN") & (text == "false"))
            | (F.coalesce(number, F.lit(1.0)) == 0)
            | ((kind == "ARRAY") & (text == "[]"))
            | ((kind == "OBJECT") & (text == "{}"))
        )
        return F.struct(answer.alias("answer"), F.when(F.coalesce(empty, F.lit(True)), 0.0).otherwise(1.0).alias("score"))

    seen = F.struct(
        F.coalesce(json_kind(v), F.lit("VOID")).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")
    )
    return let(seen, body)


def reply_json(reply: Column) -> Column:
    """JSON text of a model reply: the first fenced part if there is one, else the whole."""
    raw = strip(reply)
    fenced = strip(F.try_element_at(F.split(raw, "```"), F.lit(2)))
    untagged = F.when(fenced.startswith("json"), strip(F.substring(fenced, 5, 1 << 30))).otherwise(fenced)
    return F.coalesce(untagged, raw)


def reply_answers(reply: Column, keys: Sequence[str]) -> Column:
    """Map of every key to its struct(answer, score); a broken reply answers nothing."""

    def body(parsed: Column) -> Column:
        whole = F.when(json_kind(parsed) == "OBJECT", parsed)
        return F.create_map(*[x for k in keys for x in (F.lit(k), scalar_answer(field(whole, k)))])

    return let(strict_json(reply_json(reply)), body)


def sidecar_payload(output: Column) -> Column:
    """struct(payload, error) of a tool's output: JSON from the first ``{`` on."""
    at = F.instr(output, "{")
    body = F.when(at > 0, output.substr(at, F.length(output)))
    def verdict(r: Column) -> Column:
        said = F.try_variant_get(r["parsed"], "$.error", "string")
        error = (
            F.when(at == 0, "No JSON object found in output")
            .when(r["parsed"].isNull(), "Output is not valid JSON")
            .when(F.coalesce(said, F.lit("")) != "", said)
        )
        return F.struct(F.when(error.isNull(), r["body"]).alias("payload"), error.alias("error"))

    return let(F.struct(body.alias("body"), strict_json(body).alias("parsed")), verdict)


def override_answers(old: Column, edits: Column) -> Column:
    """Edited answers score 1.0, unchanged ones keep their score, keys without an edit stay."""
    return F.map_zip_with(
        old,
        edits,
        lambda _, was, now: F.when(now.isNull(), was).otherwise(
            F.struct(
                now.alias("answer"),
                F.when(now == F.coalesce(was["answer"], F.lit("")), F.coalesce(was["score"], F.lit(0.0)))
                .otherwise(1.0)
                .alias("score"),
            )
        ),
    )


def append_warning(warnings: Column, message: Column) -> Column:
    """JSON array text with ``message`` added; anything but an array counts as empty."""
    is_list = F.json_array_length(warnings).isNotNull()
    items = F.when(is_list, F.from_json(warnings, "array<string>"))
    return F.to_json(F.array_append(F.coalesce(items, F.array().cast("array<string>")), message))
