"""Model answers against a declared schema, and the fold over a chain's attempts: an answer, one repair, the next model.

An answer is valid if it is a JSON object with all declared fields and no other, each of its type, and each word from
its list. What is wrong is said in the order of the fields. All of it is columns over parsed variants.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------
VERDICTS = ("supported", "needs_qualifier", "unsupported", "contradicted", "off_label")
VIOLATIONS = (
    "overstated_efficacy", "unsubstantiated_superiority", "broadened_indication", "omitted_qualifier", "minimized_risk",
    "missing_risk_information", "unsupported_absolute_claim",
)
# -----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """words: the values that a string, or each string of an array, may have. items: the fields of an array's objects, all
    of them strings; an array without items holds strings."""

    name: str
    array: bool = False
    words: tuple[str, ...] = ()
    items: tuple[str, ...] = ()


JUDGE = (Field("reasoning"), Field("verdict", words=VERDICTS), Field("violations", array=True, words=VIOLATIONS), Field("evidence", array=True, items=("chunk_id", "quote")))


def problems(answer: Column, schema: tuple[Field, ...] = JUDGE) -> Column:
    """What keeps an answer (a JSON string) from being valid; an empty array if nothing does. Null and text that is no JSON
    are one problem, as is JSON that is no object."""
    value = F.try_parse_json(answer)
    keys = F.json_object_keys(answer)
    known = F.array(*[F.lit(f.name) for f in schema])
    found: list[Column] = []
    for f in schema:
        kind = F.schema_of_variant(F.try_variant_get(value, f"$.{f.name}", "variant"))
        parts = F.try_variant_get(value, f"$.{f.name}", "array<variant>")
        wrong = None
        if not f.array:
            fits = kind == "STRING"
            wrong = F.when(fits & ~F.try_variant_get(value, f"$.{f.name}", "string").isin(*f.words), f"{f.name}: not a known word") if f.words else None
        else:
            fits = F.startswith(kind, F.lit("ARRAY<"))
            item = "OBJECT<" + ", ".join(f"{x}: STRING" for x in sorted(f.items)) + ">" if f.items else "STRING"
            wrong = F.when(fits & F.exists(parts, _other_kind(item)), f"{f.name}: a wrong item")
            if f.words:
                wrong = wrong.when(fits & F.exists(parts, _other_word(f.words)), f"{f.name}: not a known word")
        missing = ~F.array_contains(keys, f.name)
        found.append(F.when(missing, f"{f.name}: missing").when(~F.coalesce(fits, F.lit(False)), f"{f.name}: not {'an array' if f.array else 'a string'}"))
        if wrong is not None:
            found.append(F.when(~missing, wrong))
    more = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(k, F.lit(": unknown")))
    every = F.concat(F.filter(F.array(*found), lambda x: x.isNotNull()), more)
    return F.when(value.isNull(), F.array(F.lit("not JSON"))).when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(every)


def _other_kind(item: str):
    return lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")) != item


def _other_word(words: tuple[str, ...]):
    return lambda x: ~F.coalesce(F.try_variant_get(x, "$", "string").isin(*words), F.lit(False))


def parsed(answer: Column) -> Column:
    """A valid judge answer as a struct."""
    return F.from_json(answer, "reasoning string, verdict string, violations array<string>, evidence array<struct<chunk_id:string,quote:string>>")


def settled(attempts: DataFrame, key: str, model: str, order: str, answer: str, schema: tuple[Field, ...] = JUDGE, rejected: Column | None = None) -> DataFrame:
    """(key, model, repaired, asked, reasons, answer) for each key: the first attempt in order that is valid and not
    rejected. A model has its first answer and one repair, later ones of it were never asked, nor is anything after the one
    that is used. asked counts attempts up to it, reasons say why those before it fell. Without one, model and answer are
    null and all attempts were asked. rejected: a column that is a reason, or null."""
    turn = F.row_number().over(Window.partitionBy(key, model).orderBy(order))
    tried = attempts.select(key, model, F.col(order).alias("o"), turn.alias("turn"), F.col(answer).alias("answer"), problems(F.col(answer), schema).alias("p"), (rejected if rejected is not None else F.lit(None).cast("string")).alias("r"))
    tried = tried.where("turn <= 2").withColumn("why", F.when(F.size("p") > 0, F.array_join("p", "; ")).otherwise(F.col("r")))
    # a rejected answer was valid: it is not repaired, the next model is asked
    before = F.lag(F.struct(F.size("p").alias("p"), "r")).over(Window.partitionBy(key, model).orderBy("o"))
    tried = tried.withColumn("b", before).where("turn = 1 or b.p > 0")
    good = F.when(F.col("why").isNull(), F.col("o"))
    used = F.min(good).over(Window.partitionBy(key))
    tried = tried.withColumn("used", used).where("used is null or o <= used")
    mine = F.col("o") == F.col("used")
    return tried.groupBy(key).agg(
        F.max(F.when(mine, F.col(model))).alias("model"), F.max(F.when(mine, F.col("turn") == 2)).alias("repaired"), F.count("*").alias("asked"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("o", "why")))), lambda x: x["why"]).alias("reasons"),
        F.max(F.when(mine, F.col("answer"))).alias("answer"),
    )
