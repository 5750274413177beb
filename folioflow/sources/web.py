"""Texts of web services as columns: weather pages and answers, server-sent events, CI metrics. Nothing here calls a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

# Where a weather page's state holds its values.
PAGE = {"temperature_f": r'"temperature":\s*(-?\d+(?:\.\d+)?)', "feels_like_f": r'"temperatureFeelsLike":\s*(-?\d+(?:\.\d+)?)', "humidity": r'"relativeHumidity":\s*(\d+)', "wind_speed": r'"windSpeed":\s*(-?\d+(?:\.\d+)?)', "wind_direction": r'"windDirectionCardinal":\s*"([^"]+)"'}
CONDITION = (r'"wxPhraseLong":\s*"([^"]+)"', r'"phrase":\s*"([^"]+)"', r'"description":\s*"([^"]+)"')


def celsius(fahrenheit: Column) -> Column:
    return F.bround((fahrenheit - 32) * 5 / 9, 1)


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def weather_of_page(page: Column | str) -> Column:
    """struct of the first values on a weather page."""
    c = T.col(page)
    value = {k: _first(c, p) for k, p in PAGE.items()}
    f = value["temperature_f"].cast("double")
    wind = F.concat_ws(" ", F.concat(F.regexp_replace(value["wind_speed"], r"\.0+$", ""), F.lit(" mph")), F.when(value["wind_speed"].isNotNull(), value["wind_direction"]))
    return F.struct(f.alias("temperature_f"), celsius(f).alias("temperature_c"), F.coalesce(*(_first(c, p) for p in CONDITION)).alias("condition"), value["feels_like_f"].cast("double").alias("feels_like_f"), value["humidity"].cast("int").alias("humidity"), F.nullif(wind, F.lit("")).alias("wind"))


def weather_of_json(answer: Column | str) -> Column:
    """The same of a JSON answer with a list of current conditions."""
    at = lambda k: F.get_json_object(T.col(answer), f"$.current_condition[0].{k}")
    f = at("temp_F").cast("double")
    wind = F.concat_ws(" ", F.concat(at("windspeedMiles"), F.lit(" mph")), F.when(at("windspeedMiles").isNotNull(), at("winddir16Point")))
    return F.struct(f.alias("temperature_f"), F.coalesce(F.nullif(at("temp_C").cast("double"), F.lit(0.0)), celsius(f)).alias("temperature_c"), at("weatherDesc[0].value").alias("condition"), at("FeelsLikeF").cast("double").alias("feels_like_f"), at("humidity").cast("int").alias("humidity"), F.nullif(wind, F.lit("")).alias("wind"))


def frames(events: DataFrame, event: str = "event") -> DataFrame:
    """A server-sent frame for each row, its other columns as JSON."""
    return events.select("*", F.concat(F.lit("event: "), F.coalesce(event, F.lit("message")), F.lit("\ndata: "), F.to_json(F.struct(*events.columns)), F.lit("\n\n")).alias("frame"))


def events_of(streams: DataFrame, text: str = "text") -> DataFrame:
    """Rows (the other columns, seq, event, data) of streams of server-sent frames; data lines of a frame are joined."""
    keep = [c for c in streams.columns if c != text]
    cut = streams.select(*keep, F.posexplode(F.filter(F.split(text, r"\r?\n\r?\n"), lambda f: F.trim(f) != "")).alias("seq", "frame"))
    held = lambda name: F.transform(F.filter(F.split("frame", r"\r?\n"), lambda x: F.startswith(x, F.lit(f"{name}:"))), lambda x: F.regexp_replace(x, rf"^{name}: ?", ""))
    return cut.select(*keep, "seq", F.coalesce(F.get(held("event"), F.lit(0)), F.lit("message")).alias("event"), F.array_join(held("data"), "\n").alias("data"))


def ci_metrics(reports: DataFrame, json: str = "report") -> DataFrame:
    """Rows (project, metric, value) of JSON reports with a component's measures, for a TSV sink."""
    kind = "struct<component:struct<key:string,measures:array<struct<metric:string,value:string>>>>"
    return reports.select(F.from_json(json, kind).alias("r")).select(F.col("r.component.key").alias("project"), F.explode("r.component.measures").alias("m")).select("project", "m.metric", F.col("m.value").cast("double").alias("value"))


#: A test run's suites, inside one element or alone, and a coverage report's root, as from_xml reads them.
SUITE = "_tests string, _failures string, _errors string, _skipped string, _time string"
REPORT = f"{SUITE}, `_line-rate` string, testsuite array<struct<{SUITE}>>, _corrupt_record string"
#: A suite's attributes and the metrics that they sum up to.
SUITE_METRICS = {"_tests": "tests", "_failures": "test_failures", "_errors": "test_errors", "_skipped": "skipped_tests", "_time": "test_execution_time_ms"}


def ci_reports(reports: DataFrame, xml: str = "report", project: str = "project") -> DataFrame:
    """Rows (project, metric, value, source) of XML reports: coverage in percent, and sums over a run's suites, times in milliseconds.

    A text that is no XML gives a row with the metric `corrupt` and no value; an attribute that isn't there counts as 0.
    """
    root = F.regexp_extract(xml, r"<([A-Za-z][\w.-]*)(?=[\s/>])", 1)
    parsed = reports.select(F.col(project).alias("project"), root.alias("root"), F.from_xml(xml, REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    own = F.array(F.struct(*(F.col(f"r.{a}").alias(a) for a in SUITE_METRICS)))
    suites = F.when(F.col("root") == "testsuite", own).otherwise(F.coalesce("r.testsuite", own))
    over = lambda a: F.aggregate(suites, F.lit(0.0), lambda s, x: s + number(x[a]))
    sums = {m: over(a) for a, m in SUITE_METRICS.items()}
    sums["test_execution_time_ms"] = F.round(sums["test_execution_time_ms"] * 1000)
    metric = lambda name, value, source: F.struct(F.lit(name).alias("metric"), value.alias("value"), F.lit(source).alias("source"))
    coverage = F.array(metric("coverage_percent", F.round(F.col("r.`_line-rate`").try_cast("double") * 100, 2), "LOCAL_COVERAGE_XML"))
    run = F.array(*(metric(m, v, "LOCAL_JUNIT_XML") for m, v in sums.items()))
    corrupt = F.array(metric("corrupt", F.lit(None).cast("double"), "UNREADABLE"))
    found = F.when(bad, corrupt).when(F.col("root") == "coverage", coverage).when(F.col("root").isin("testsuite", "testsuites"), run)
    return parsed.select("project", F.explode(found).alias("m")).select("project", "m.*")


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)
