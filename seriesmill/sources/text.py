"""Text exposition: samples, metadata and errors of scraped lines, by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import once

ERRORS = {1: "unexpected token", 2: "no metric name", 3: "invalid UTF-8", 4: "invalid value", 5: "invalid timestamp"}
NAME, LABEL = r"[a-zA-Z_:][a-zA-Z0-9_:]*", r"[a-zA-Z_][a-zA-Z0-9_]*"
#: Possessive, so that a value is read in one go: a pattern that may go back recurses for each character.
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
BODY = rf"\{{(?:[^\"}}]++|{QUOTED})*+\}}"
#: Name, value, time, rest and label list; a line has no newline, so it can part them.
SAMPLE = rf"(?s)^[ \t]*+({NAME})?[ \t]*+({BODY})?[ \t]*+([^ \t{{}}]*+)[ \t]*+([^ \t]*+)[ \t]*+(.*)\z"
PARTS = ("name", "raw", "stamp", "rest", "body")
PAIR = rf"({LABEL})[ \t]*+=[ \t]*+({QUOTED})"
PAIRS = rf"(?s)^\{{[ \t]*+(?:{PAIR}[ \t]*+,?[ \t]*+)*+\}}\z"
VALUE = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z|^[+-]?(?:[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])\z"
META = rf"(?s)^[ \t]*#[ \t]*(HELP|TYPE|UNIT)[ \t]+({NAME})(?:[ \t]+(.*))?\z"


def lines_of(payloads: DataFrame) -> DataFrame:
    """(payload_id, line_no, line, valid) of payloads(payload_id, body binary or string)."""
    body = F.col("body").cast("binary")
    valid = F.is_valid_utf8(body.cast("string"))
    text = F.split(F.make_valid_utf8(body.cast("string")), "\n")
    return payloads.select("payload_id", valid.alias("payload_valid"), F.posexplode(text).alias("line_no", "line")).withColumn("valid", F.col("payload_valid") | ~F.contains("line", F.lit("�"))).drop("payload_valid")


def unescape(value: Column) -> Column:
    """Backslash sequences of a quoted label value: two backslashes are split off first."""
    part = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.array_join(F.transform(F.split(value, r"\\\\"), part), "\\")


def _labels(name: Column, body: Column) -> Column:
    """The labels of a list that has the right form: empty values are left out."""

    def pair(text: Column) -> Column:
        start = F.instr(text, F.lit('"'))
        key = F.regexp_extract(text, LABEL, 0)
        return F.struct(key.alias("key"), unescape(F.substring(text, start + 1, F.length(text) - start - 1)).alias("value"))

    pairs = F.transform(F.regexp_extract_all(body, F.lit("(?s)" + PAIR), F.lit(0)), pair)
    kept = F.filter(pairs, lambda e: (e["value"] != "") & (e["key"] != "__name__"))
    return F.map_from_entries(F.array_append(kept, F.struct(F.lit("__name__").alias("key"), name.alias("value"))))


def parse_samples(lines: DataFrame, open_metrics: bool = False) -> DataFrame:
    """(payload_id, line_no, labels, ts_ms (null: default), value, error) of the lines that hold samples.

    error is null or a key of ERRORS. In the OpenMetrics form timestamps are seconds, exemplars after a #
    are dropped, and what follows # EOF is not read.
    """
    if "valid" not in lines.columns:
        lines = lines.withColumn("valid", F.lit(True))
    if open_metrics:
        end = lines.where(F.col("line").rlike(r"^# EOF\s*\z")).groupBy("payload_id").agg(F.min("line_no").alias("eof"))
        lines = lines.join(end, "payload_id", "left").where("eof is null or line_no < eof").drop("eof")
    text = F.col("line")
    kept = lines.where(~text.rlike(r"^[ \t\r]*(?:#|\z)"))
    parts = F.split(F.regexp_replace(text, SAMPLE, "$1\n$3\n$4\n$5\n$2"), "\n")  # one match a line
    got = once(kept, "parts", parts).withColumns({k: F.coalesce(F.get("parts", n), F.lit("")) for n, k in enumerate(PARTS)}).drop("parts")
    if open_metrics:
        exemplar = (F.col("stamp") == "#") | F.col("rest").startswith("#")
        got = got.withColumns({"rest": F.when(exemplar, "").otherwise(F.col("rest")), "stamp": F.when(F.col("stamp") == "#", "").otherwise(F.col("stamp"))})
        stamp = F.floor(F.expr("try_cast(stamp as double)") * 1000 + 0.5).cast("long")
    else:
        stamp = F.expr("try_cast(stamp as bigint)")
    value = F.when(F.col("raw").rlike(VALUE), F.expr("try_cast(raw as double)"))
    body = F.col("body")
    error = (
        F.when(~F.col("valid"), 3)
        .when((F.col("name") == "") & text.rlike(r"^[ \t]*\{"), 2)
        .when((F.col("name") == "") | (F.col("raw") == "") | ((body != "") & ~body.rlike(PAIRS)) | (F.col("rest") != ""), 1)
        .when(value.isNull(), 4)
        .when((F.col("stamp") != "") & (stamp.isNull() | ~F.col("stamp").rlike(r"^-?[0-9.eE+]+\z")), 5)
    )
    full = once(got, "error", error)
    fine = F.col("error").isNull()
    return full.select("payload_id", "line_no", F.when(fine, _labels(F.col("name"), body)).alias("labels"), F.when(fine & (F.col("stamp") != ""), stamp).alias("ts_ms"), F.when(fine, value).alias("value"), "error")


def accepted(samples: DataFrame) -> DataFrame:
    """Samples of payloads without an error: one bad line rejects its payload."""
    bad = samples.where("error is not null").select("payload_id").distinct()
    return samples.join(bad, "payload_id", "left_anti").drop("error")


def payload_errors(samples: DataFrame) -> DataFrame:
    """(payload_id, scraped, error): the number of samples, or 0 and the first error."""
    got = samples.groupBy("payload_id").agg(F.count_if(F.col("error").isNull()).alias("n"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("line_no"))).alias("error"))
    return got.select("payload_id", F.when(F.col("error").isNull(), F.col("n")).otherwise(0).alias("scraped"), "error")


def parse_metadata(lines: DataFrame) -> DataFrame:
    """(payload_id, line_no, metric_name, kind, text): HELP, TYPE and UNIT lines; texts are as given."""
    got = lines.where(F.col("line").rlike(META))
    return got.select("payload_id", "line_no", F.regexp_extract("line", META, 2).alias("metric_name"), F.lower(F.regexp_extract("line", META, 1)).alias("kind"), F.rtrim(F.coalesce(F.regexp_extract("line", META, 3), F.lit(""))).alias("text"))


def render(samples: DataFrame) -> Column:
    """A line of exposition for samples(labels, value, ts_ms)."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    rest = F.filter(F.array_sort(F.map_entries("labels")), lambda e: e["key"] != "__name__")
    body = F.array_join(F.transform(rest, lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), ",")
    return F.concat(F.try_element_at("labels", F.lit("__name__")), F.lit("{"), body, F.lit("} "), F.col("value").cast("string"), F.lit(" "), F.col("ts_ms").cast("string"))
