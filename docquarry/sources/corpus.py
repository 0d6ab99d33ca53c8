"""A demonstration corpus: topics times variants, slots filled alike throughout a document."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _draw(*parts: Column) -> Column:
    """A number below 2^32 that the parts alone decide, in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def filled(text: Column, document: Column, slots: Mapping[str, Sequence[str]], seed: int = 0) -> Column:
    """text with each {slot} replaced by one of its values, the same wherever the document names the slot."""
    for name, values in slots.items():
        at = (_draw(F.lit(f"{seed}:{name}"), document.cast("string")) % len(values) + 1).cast("int")
        text = F.replace(text, F.lit("{" + name + "}"), F.element_at(F.array(*map(F.lit, values)), at))
    return text


def corpus(templates: DataFrame, variants: int, slots: Mapping[str, Sequence[str]], owners: Sequence[str], seed: int = 0) -> DataFrame:
    """(document_id, topic, variant, title, body, owner): so many variants of each template (topic, title, body), numbered from 1 topic by topic.

    Any size is generated where it is needed: rows are exploded, not collected; only the topics, which are
    few, are numbered by name. Variants carry a letter after the title.
    """
    numbered = templates.select("topic", "title", "body").withColumn("n", F.size(F.filter(F.lit(templates.select(F.sort_array(F.collect_set("topic"))).first()[0]), lambda t: t < F.col("topic"))))
    rows = numbered.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    doc = (F.col("n") * variants + F.col("variant") + 1).cast("long")
    letter = F.when(F.col("variant") < 26, F.concat(F.lit(" ("), F.chr(F.col("variant") + 65), F.lit(")"))).otherwise("")
    owner = F.element_at(F.array(*map(F.lit, owners)), (_draw(F.lit(f"{seed}:owner"), doc.cast("string")) % len(owners) + 1).cast("int"))
    return rows.select(doc.alias("document_id"), "topic", "variant", F.concat(filled(F.col("title"), doc, slots, seed), letter).alias("title"), filled(F.col("body"), doc, slots, seed).alias("body"), owner.alias("owner"))


def grants(documents: DataFrame, readers: Sequence[str], each: int, seed: int = 0) -> DataFrame:
    """(username, document_id): so many documents for each reader, none their own, drawn by hash."""
    from pyspark.sql import Window

    asked = documents.select("document_id", "owner", F.explode(F.array(*map(F.lit, readers))).alias("username")).where("owner <> username")
    drawn = F.row_number().over(Window.partitionBy("username").orderBy(_draw(F.lit(str(seed)), F.col("username"), F.col("document_id").cast("string")), "document_id"))
    return asked.withColumn("_r", drawn).where(F.col("_r") <= each).select("username", "document_id")
