"""Tables in and out: Parquet, JDBC, imports, registry responses, mail feeds, audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_control

MAIL_SCHEMA = "Type string, Message string"
MAIL_MESSAGE = "notificationType string, eventType string, mail struct<messageId:string,destination:array<string>,timestamp:string>, bounce struct<bounceType:string,bounceSubType:string,timestamp:string>, complaint struct<complaintFeedbackType:string,timestamp:string>, delivery struct<timestamp:string>, open struct<timestamp:string>, click struct<timestamp:string>"
REGISTRY = "ico string, obchodniJmeno string, nazev string, dic string, pravniForma string, sidlo struct<nazevUlice:string,cisloDomovni:string,cisloOrientacni:string,nazevObce:string,nazevCastiObce:string,nazevMestskeCastiObvodu:string,psc:string>, stavSubjektu string"
# Statuses of the registry.
REGISTRY_STATUS = {"AKTIVNI": "Aktivní", "ZANIKLÝ": "Zaniklý", "ZANIKLY": "Zaniklý", "NEAKTIVNI": "Neaktivní", "PRERUSENA_CINNOST": "Přerušená činnost"}


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table (S1); a declared schema spares reading footers."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table, read in parallel by ranges of a column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A Parquet table, partitioned by columns of few values."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_urls(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Rows (url) of an import in JSON, CSV with a header, or Parquet (S2); values that are no strings become null."""
    if kind == "json":
        return spark.read.schema("url string").json(path)
    return spark.read.schema("url string").csv(path, header=True) if kind == "csv" else spark.read.parquet(path).select(F.col("url").cast("string"))


def cleaned(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns without control characters."""
    return df.withColumns({c: clean_control(F.col(c)) for c in columns})


def _envelopes(raw: DataFrame, value: str | None) -> DataFrame:
    """Envelopes with their text (raw) and message (m); the columns are null where the JSON doesn't parse."""
    if value:
        raw = raw.select(F.col(value).alias("raw"), F.from_json(value, MAIL_SCHEMA).alias("e")).select("raw", "e.*")
    else:
        raw = raw.select(F.to_json(F.struct("Type", "Message")).alias("raw"), "Type", "Message")
    return raw.withColumn("m", F.from_json("Message", MAIL_MESSAGE))


def mail_events(raw: DataFrame, value: str | None = None) -> DataFrame:
    """Envelopes (Type, Message) or their JSON in column ``value`` to events; what is no notification or has no id is dropped."""
    m = _envelopes(raw, value).where(F.col("Type") == "Notification").select("m.*")
    kind = F.lower(F.coalesce("notificationType", "eventType"))
    at = F.coalesce("bounce.timestamp", "complaint.timestamp", "delivery.timestamp", "open.timestamp", "click.timestamp", "mail.timestamp")
    events = m.select(
        F.try_to_timestamp(at).alias("event_time"), kind.alias("type"), F.col("mail.messageId").alias("message_id"), F.lower(F.get("mail.destination", F.lit(0))).alias("email"),
        F.col("bounce.bounceType").alias("bounce_type"), F.col("bounce.bounceSubType").alias("bounce_sub_type"), F.col("complaint.complaintFeedbackType").alias("feedback_type"),
    )
    return events.where("message_id is not null and type is not null")


def mail_rejects(raw: DataFrame, value: str | None = None) -> DataFrame:
    """What ``mail_events`` drops (S5): its text (raw) and the reason: no envelope, another type of envelope, a message that doesn't parse,
    one without kind or without id."""
    e = _envelopes(raw, value)
    kind, id_ = F.coalesce("m.notificationType", "m.eventType"), F.col("m.mail.messageId")
    parsed = F.col("m.mail").isNotNull() | kind.isNotNull()
    reason = (
        F.when(F.col("Type").isNull(), "envelope").when(F.col("Type") != "Notification", "type").when(~parsed | F.col("m").isNull(), "message")
        .when(kind.isNull(), "kind").when(id_.isNull(), "id")
    )
    return e.select("raw", reason.alias("reason")).where("reason is not null")


def _nonempty(c: Column) -> Column:
    return F.when(~c.isin("", "0"), c)


def companies(responses: DataFrame, value: str = "response") -> DataFrame:
    """Registry responses (JSON) as companies with street, full address and mapped status."""
    r = responses.select(F.from_json(value, REGISTRY).alias("r"), F.col(value).alias("raw_data")).select("r.*", "raw_data")
    a = lambda f: F.col(f"sidlo.{f}")
    number = F.when(_nonempty(a("cisloDomovni")).isNotNull(), F.concat_ws("/", _nonempty(a("cisloDomovni")), _nonempty(a("cisloOrientacni"))))
    street = F.nullif(F.concat_ws(" ", _nonempty(a("nazevUlice")), number), F.lit(""))
    status = F.col("stavSubjektu")
    for k, v in REGISTRY_STATUS.items():
        status = F.when(F.col("stavSubjektu") == k, F.lit(v)).otherwise(status)
    form = F.coalesce(F.get_json_object("pravniForma", "$.nazev"), F.get_json_object("pravniForma", "$.kod"))
    rows = r.select(
        F.coalesce("ico", F.lit("")).alias("ico"), F.coalesce("obchodniJmeno", "nazev", F.lit("")).alias("name"), "dic", form.alias("legal_form"), street.alias("street"), a("nazevObce").alias("city"),
        F.coalesce(a("nazevCastiObce"), a("nazevMestskeCastiObvodu")).alias("city_part"), a("psc").alias("postal_code"), status.alias("business_status"), "raw_data",
    )
    part = F.when(F.col("city_part") != F.col("city"), F.col("city_part"))
    town = F.when(F.col("city").isNotNull(), F.concat_ws(" ", "postal_code", "city"))
    address = F.nullif(F.concat_ws(", ", "street", part, town), F.lit(""))
    return rows.withColumn("is_active", F.coalesce(F.col("business_status") == "Aktivní", F.lit(False))).withColumn("full_address", address)


def report(issues: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An audit's summary by category, and its issues from severe to mild with the run's status."""
    summary = issues.groupBy("analysis_id", "category").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "critical").alias("critical"), F.sum("weight").alias("score"))
    order = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "recommended", 1).otherwise(2)
    listed = issues.join(runs.select("analysis_id", "status"), "analysis_id", "left").withColumn("position", F.row_number().over(Window.partitionBy("analysis_id").orderBy(order, "category", "code")))
    return summary, listed


def report_markdown(listed: DataFrame) -> DataFrame:
    """One Markdown text for each run."""
    line = F.concat(F.lit("- **"), F.col("severity"), F.lit("** "), F.col("code"), F.coalesce(F.concat(F.lit(": "), "evidence"), F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return listed.groupBy("analysis_id").agg(F.concat_ws("\n", F.concat(F.lit("# Audit "), F.first("analysis_id").cast("string")), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("report"))
