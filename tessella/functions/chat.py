"""Chat messages as columns: normalising, rendering, pruning and building them.

A message is a struct (role, content_text, content_parts): the first content is
set if it was a string, the second if it was a list of parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: what stands for data that is left out.
PRUNED = "[pruned]"


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<url:string,detail:string>").alias("image_url"))


def image_part(url: Column, detail: str | None = "high") -> Column:
    return F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(url.alias("url"), F.lit(detail).cast("string").alias("detail")).alias("image_url"))


def message(role: Column, text: Column | None = None, parts: Column | None = None) -> Column:
    empty = F.lit(None).cast("array<struct<type:string,text:string,image_url:struct<url:string,detail:string>>>")
    return F.struct(role.alias("role"), (F.lit(None).cast("string") if text is None else text).alias("content_text"), (empty if parts is None else parts).alias("content_parts"))


def query_message(text: Column, image_url: Column | None = None, detail: str | None = "high") -> Column:
    """H8: a user's message; an image goes before the text."""
    parts = F.array(text_part(text))
    return message(F.lit("user"), parts=parts if image_url is None else F.array_prepend(parts, image_part(image_url, detail)))


def with_context(context: Column, query: Column) -> Column:
    """H8: the messages so far and the new one."""
    return F.array_append(context, query)


def pruned(m: Column) -> Column:
    """a message whose parts other than text hold a mark under their own key, in place of their data; a kind without a key of its own keeps the kind alone."""
    mark = F.struct(F.lit(PRUNED).alias("url"), F.lit(None).cast("string").alias("detail"))
    kept = F.transform(m["content_parts"], lambda p: F.when(p["type"] == "text", p).otherwise(F.struct(p["type"].alias("type"), F.lit(None).cast("string").alias("text"), F.when(p["type"] == "image_url", mark).alias("image_url"))))
    return F.struct(m["role"].alias("role"), m["content_text"].alias("content_text"), kept.alias("content_parts"))


def formatted(messages: Column, omit_image_data: bool = True, omit_system_prompt: bool = True) -> Column:
    """a transcript; each message is its role in brackets, its content and a line feed.  Malformed parts show what is wrong.

    Fixed values: the texts in angle brackets.
    """

    def part(p: Column) -> Column:
        url = p["image_url"]["url"]
        image = F.lit("<image>") if omit_image_data else F.concat(F.lit("[image_url]("), F.coalesce(url, F.lit("<image url missing>")), F.lit(")"))
        return (
            F.when(p["type"].isNull(), F.lit("<content part missing 'type'>"))
            .when(p["type"] == "text", F.coalesce(p["text"], F.lit("<content part text missing>")))
            .when(p["image_url"].isNotNull(), image)
            .otherwise(F.concat(F.lit("<unexpected content part type: "), p["type"], F.lit(">")))
        )

    def one(m: Column) -> Column:
        role = F.upper(F.coalesce(m["role"], F.lit("unknown")))
        content = F.coalesce(m["content_text"], F.array_join(F.transform(m["content_parts"], part), ""), F.lit("<content missing>"))
        return F.concat(F.lit("["), role, F.lit("]\n"), content, F.lit("\n"))

    shown = F.filter(messages, lambda m: F.upper(F.coalesce(m["role"], F.lit(""))) != "SYSTEM") if omit_system_prompt else messages
    return F.array_join(F.transform(shown, one), "")


def framed(agent: Column, transcript: Column) -> Column:
    """an agent's transcript between its start and its stop line."""
    #: What stands before and after the agent's name in both lines; the last is one longer.
    before, after = ">>>>>>>>>>>>>>>>>>> ", " messages start >>>>>>>>>>>>>>>>>>>\n"
    last, end = "<<<<<<<<<<<<<<<<<<< ", " messages stop <<<<<<<<<<<<<<<<<<<<\n"
    return F.concat(F.lit(before), agent, F.lit(after), transcript, F.lit(last), agent, F.lit(end))


def normalised(raw: Column) -> Column:
    """M6: a message held as a variant, whose content is null, a string or a list of parts."""
    kind = F.schema_of_variant(F.try_variant_get(raw, "$.content", "variant"))
    parts = F.try_variant_get(raw, "$.content", "array<struct<type:string,text:string,image_url:struct<url:string,detail:string>>>")
    return message(F.try_variant_get(raw, "$.role", "string"), F.when(kind == "STRING", F.try_variant_get(raw, "$.content", "string")), F.when(kind.startswith("ARRAY"), parts))
