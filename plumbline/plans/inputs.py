"""Engine inputs derived from the test tables by arithmetic, alike in every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRINTS = {
    "plain": "concat(whole, '.', frac)",
    "thousands": "case when whole >= 1000 then concat(whole div 1000, ',', lpad(whole % 1000, 3, '0'), '.', frac) else concat(whole, '.', frac) end",
    "comma": "case when whole >= 1000 then concat(whole div 1000, '.', lpad(whole % 1000, 3, '0'), ',', frac) else concat(whole, ',', frac) end",
    "worded": "concat('USD ', whole, '.', frac, ' only')",
}


def priced(df: DataFrame, price: str) -> DataFrame:
    """Adds the whole and the two-digit fraction of a price, and its prints."""
    cents = F.round(F.col(price) * 100).cast("long")
    df = df.withColumns({"whole": F.expr("0L"), "frac": F.lit("")}).withColumn("whole", F.floor(cents / 100).cast("long")).withColumn("frac", F.lpad((cents % 100).cast("string"), 2, "0"))
    return df.withColumns({f"p_{k}": F.expr(v) for k, v in PRINTS.items()})


def order_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "d/M/yyyy").alias("dmy"))
    return priced(o, "o_totalprice").withColumn("document_id", F.concat(F.lit("o-"), F.col("k").cast("string")))


# name, kind, required of the fields that stand on the page of an order
ORDER_FIELDS = [("total", "currency", True), ("status", "string", True), ("date", "date", True), ("po", "string", False), ("ref", "string", True)]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of each order: as printed, written otherwise, and with misreadings and gaps by its key."""
    o = order_fields(spark, sf_dir)
    rows = o.selectExpr("document_id", """stack(9,
      'total', 'currency', 0, p_plain, 'total', 'currency', 1, p_thousands,
      'total', 'currency', 2, case when k % 5 = 0 then null when k % 7 = 0 then concat(whole + 1, '.', frac) else p_comma end,
      'status', 'string', 0, o_orderstatus, 'status', 'string', 1, lower(o_orderstatus),
      'status', 'string', 2, case when k % 3 = 0 then concat('X', o_orderstatus) else o_orderstatus end,
      'date', 'date', 0, iso, 'date', 'date', 1, dmy, 'date', 'date', 2, case when k % 4 = 0 then '31/02/2020' else iso end)
      as (field, kind, ord, raw_value)""").where("raw_value is not null")
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    return rows.withColumns({"pass_id": F.concat(F.lit("pass-"), F.col("ord").cast("string")), "quote": F.lit(None).cast("string"), "bbox": none, "total_passes": F.lit(3)})


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared fields of each order with its page's text, blank for every eleventh."""
    o = order_fields(spark, sf_dir)
    page = F.when(F.col("k") % 11 == 0, " ").otherwise(F.concat_ws("\n", F.concat(F.lit("Order "), F.col("k").cast("string")), F.concat(F.lit("Total: "), F.col("p_plain")), F.concat(F.lit("Status "), F.col("o_orderstatus")), F.col("iso")))
    fields = F.array(*(F.struct(F.lit(n).alias("field"), F.lit(k).alias("kind"), F.lit(r).alias("required")) for n, k, r in ORDER_FIELDS))
    return o.select("document_id", page.alias("reference_text"), F.explode(fields).alias("f")).select("document_id", "f.*", "reference_text", F.lit("order").alias("schema_name"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: the printed values, but another total for every thirteenth order, no date for every ninth, no po."""
    o = order_fields(spark, sf_dir)
    return o.selectExpr("document_id", """stack(5,
      'total', case when k % 13 = 0 then concat(whole + 7, '.', frac) else p_thousands end, 'status', o_orderstatus,
      'date', case when k % 9 = 0 then null else dmy end, 'po', cast(null as string), 'ref', concat('R', k)) as (field, expected)""")


def plate(k: str) -> str:
    """SQL of a registration made of a key: three letters and three digits."""
    return f"concat(chr(cast(65 + {k} % 26 as int)), chr(cast(65 + ({k} * 7) % 26 as int)), chr(cast(65 + ({k} * 11) % 26 as int)), lpad(cast({k} % 1000 as string), 3, '0'))"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four readings of a plate for each customer: with its banner, dashed, sometimes misread, sometimes blank."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("plate", F.expr(plate("k")))
    return c.selectExpr("concat('c-', k) as image_id", """stack(4,
      0, 1.5D, 'us_plate', array('TEXAS', plate, 'THE LONE STAR STATE'),
      1, 1.0D, 'us_plate', array(lower(concat(left(plate, 3), '-', right(plate, 3)))),
      2, 1.0D, case when k % 10 = 0 then 'sign' else 'us_plate' end, array(case when k % 4 = 0 then concat(left(plate, 5), 'X') else plate end),
      3, 1.0D, 'us_plate', array(case when k % 3 = 0 then ' ' else plate end)) as (view_ord, weight, kind, lines)""")


def disputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of a plate for each customer, each wrong at another place."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("plate", F.expr(plate("k")))
    rows = F.expr("""transform(sequence(0, 2), i -> struct(i as view_ord, 1.0D as weight, 'us_plate' as kind, array(concat(left(plate, i + 3), case when substring(plate, i + 4, 1) = '9' then '8' else '9' end, substring(plate, i + 5))) as lines))""")
    return c.select(F.concat(F.lit("c-"), F.col("k").cast("string")).alias("image_id"), F.explode(rows).alias("r")).select("image_id", "r.*")
