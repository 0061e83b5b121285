"""Structured fields out of free-text reviews. Patterns are Java regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schema import REVIEW
from tickloom.session import materialise

# The answer format the extraction patterns expect.
DECISION = r"FINAL DECISION: (CONFIRM|REJECT)"
JUSTIFICATION = r"(?s)Justification:(.*?)(?:\n\n|\z)"
EXECUTION = r"(?iU)(Entry|Stop Loss|Take Profit)\s*:\s*\[?([\d\.-]+(?:-[\d\.-]+)?)\]?"
EXECUTION_STRICT = r"(?iU)\*(Entry|Stop Loss|Take Profit)\*:\s*\[([\d\.-]+-?[\d\.-]*)\]"
JSON_BLOCK = r"(?s)\{.*\}"
SPLIT_MARK = "FINAL DECISION:"
NO_JUSTIFICATION = "No justification provided"

KEYS = ("Entry", "Stop_Loss", "Take_Profit")


def strip(x: Column) -> Column:
    """Trim all white space, Unicode's included (``trim`` takes spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def extract_decision(text: Column) -> Column:
    """CONFIRM or REJECT; anything else is UNKNOWN."""
    found = F.regexp_extract(text, DECISION, 1)
    return F.when(found == "", "UNKNOWN").otherwise(found)


def extract_justification(text: Column) -> Column:
    """From the label to the first blank line or the end."""
    return F.when(text.rlike("(?s)Justification:"),
                  strip(F.regexp_extract(text, JUSTIFICATION, 1))).otherwise(NO_JUSTIFICATION)


def _pairs(text: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))


def _last_value(pairs: Column, key: Column, wanted: str) -> Column:
    mine = F.filter(pairs, lambda p: F.lower(p["k"]) == key)
    return F.try_element_at(mine, F.lit(-1))["v"].alias(wanted)


def execution_fields(text: Column, strict: bool = False) -> Column:
    """Struct of the three prices as text, NULL where absent; a repeated key keeps its last."""
    labels = {k: F.lit(k.replace("_", " ").lower()) for k in KEYS}

    def fields(pairs: Column) -> Column:
        return F.struct(*[
            _last_value(pairs, labels[k], k.lower() if strict else k) for k in KEYS])

    # The one-element transform names the matches once; written inline, each of the three
    # fields would run the patterns again.
    found = _pairs(text, EXECUTION_STRICT if strict else EXECUTION)
    return F.get(F.transform(F.array(found), fields), F.lit(0))


def extract_json(text: Column, schema: T.StructType | str) -> Column:
    """First-brace-to-last-brace object, strict JSON; NULL if absent or malformed. A field whose
    value has another type than ``schema`` says is NULL by itself."""
    block = F.regexp_extract(text, JSON_BLOCK, 0)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    parsed = F.try_parse_json(block)
    return F.when(parsed.isNotNull(), F.struct(*[
        F.try_variant_get(parsed, f"$['{f.name}']", f.dataType.simpleString()).alias(f.name)
        for f in schema.fields]))


def split_decision(text: Column) -> Column:
    """Text between the first mark and the next one (or the end), else ``invalid``."""
    after = F.get(F.split(text, SPLIT_MARK), F.lit(1))
    return F.when(after.isNull(), "invalid").otherwise(strip(after))


def parse_responses(df: DataFrame, text: str = "response") -> DataFrame:
    """Decision, justification and prices of every response.

    The fields come out of a generator, which filters on them do not pass: otherwise the planner
    would push such filters down and run the patterns a second time for them.
    """
    execution = execution_fields(F.col(text))
    fields = F.transform(F.array(execution), lambda e: F.struct(
        extract_decision(F.col(text)).alias("agent_decision"),
        extract_justification(F.col(text)).alias("justification"),
        e["Entry"].alias("entry"), e["Stop_Loss"].alias("stop_loss"),
        e["Take_Profit"].alias("take_profit")))
    return df.select("*", F.inline(fields))


def price_bounds(df: DataFrame) -> DataFrame:
    """Typed entry: a range ``a-b`` gives both ends, a single price gives it twice."""
    number = r"^-?[\d.]+"
    low = F.regexp_extract(F.col("entry"), number, 0)
    rest = F.regexp_extract(F.col("entry"), number + r"-(-?[\d.]+)$", 1)
    return df.withColumns({
        "entry_low": low.try_cast("double"),
        "entry_high": F.when(rest != "", rest).otherwise(low).try_cast("double"),
    })


def executions(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed rows split into complete executions and the quarantine of incomplete ones.

    Only a CONFIRM or REJECT counts as reviewed. ``numeric`` tells whether all three are numbers.
    The marked rows are written once, for both sinks.
    """
    prices = ("entry", "stop_loss", "take_profit")
    reviewed = parsed.filter(F.col("agent_decision").isin("CONFIRM", "REJECT"))
    complete = F.lit(True)
    numeric = F.lit(True)
    for p in prices:
        complete = complete & F.col(p).isNotNull()
        numeric = numeric & F.col(p).rlike(r"^[\d\.-]+$")
    marked = materialise(reviewed.withColumn("_complete", complete), "executions")
    good = marked.filter("_complete").withColumn("numeric", numeric).drop("_complete")
    return good, marked.filter("NOT _complete").drop("_complete")


def with_zones(df: DataFrame, utc: str) -> DataFrame:
    """Local (Panama) and market (+05:00) wall-clock text of a UTC time column."""
    form = "yyyy-MM-dd HH:mm:ss"
    # The session zone is irrelevant: the shift is taken on the zone-less value.
    base = F.col(utc).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Panama"), base)
    market = base + F.expr("INTERVAL 5 HOURS")
    return df.withColumns({"timestamp_local": F.date_format(local, form),
                           "timestamp_market": F.date_format(market, form)})


def review_table(parsed: DataFrame, utc: str = "ts") -> DataFrame:
    """The nine review columns, all text, absent parts empty."""
    zoned = with_zones(parsed, utc)
    return zoned.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                          for c in REVIEW.fieldNames()])


def build_requests(decided: DataFrame, utc: str = "datetime") -> DataFrame:
    """One request text per actionable decision."""
    zoned = with_zones(decided.filter(F.col("final_decision").isin("sell", "buy")), utc)
    text = F.format_string(
        "Review a %s signal for %s. Local time %s, market time %s. State FINAL DECISION "
        "(CONFIRM or REJECT), Justification, Entry, Stop Loss and Take Profit.",
        F.upper("final_decision"), F.col("currency_pair"),
        F.col("timestamp_local"), F.col("timestamp_market"))
    return zoned.withColumn("request", text)
