"""Column forms of the protocol: wire text built and read by Spark expressions, so it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\r\n"


def bulk(item: Column) -> Column:
    """A string column as a bulk string, a null as the null bulk."""
    item = item.cast("string")
    return F.coalesce(F.concat(F.lit("$"), F.octet_length(item).cast("string"), F.lit(END), item, F.lit(END)), F.lit("$-1" + END))


def command(*items: Column) -> Column:
    """An array of bulk strings."""
    return F.concat(F.lit(f"*{len(items)}{END}"), *(bulk(i) for i in items))


def arguments(commands: DataFrame, most: int = 4, wire: str = "wire") -> DataFrame:
    """commands and two more columns: ``argc``, the length that the array states, and ``args``, its first ``most`` bulk
    strings as binary. Lengths are bytes, so the text is walked as bytes: item by item, but by expressions only.

    argc is null if the text does not begin as an array; an argument is null if it is a null bulk, no bulk or not there.
    """
    out = commands.withColumn("_w", F.col(wire).cast("binary"))
    head = F.substring_index(F.col("_w").substr(F.lit(1), F.lit(24)).cast("string"), END, 1)
    out = out.withColumn("_h", head).withColumns({"argc": F.expr("if(startswith(_h, '*'), try_cast(substring(_h, 2) as int), null)"), "_p0": F.length("_h") + 3})
    for i in range(most):
        out = out.withColumn(f"_h{i}", F.substring_index(F.col("_w").substr(F.col(f"_p{i}"), F.lit(24)).cast("string"), END, 1))
        out = out.withColumn(f"_s{i}", F.col(f"_p{i}") + F.length(f"_h{i}") + 2)
        out = out.withColumn(f"_n{i}", F.expr(f"if(startswith(_h{i}, '$'), try_cast(substring(_h{i}, 2) as int), null)"))
        out = out.withColumn(f"_a{i}", F.when((F.col(f"_n{i}") >= 0) & (F.lit(i) < F.col("argc")), F.col("_w").substr(F.col(f"_s{i}"), F.col(f"_n{i}"))))
        out = out.withColumn(f"_p{i + 1}", F.col(f"_s{i}") + F.when(F.col(f"_n{i}") >= 0, F.col(f"_n{i}") + 2).otherwise(0))
    return out.select(*commands.columns, "argc", F.array(*(f"_a{i}" for i in range(most))).alias("args"))


def decoded(wire: DataFrame) -> DataFrame:
    """(lsn, wire) rows as (lsn, key, value) of their SET commands, decoded by expressions only."""
    own = arguments(wire, 3)
    return own.select("lsn", F.col("args")[1].cast("string").alias("key"), F.col("args")[2].cast("string").alias("value"))


def replies(wire: DataFrame) -> DataFrame:
    """(lsn, reply) of the commands (lsn, wire) that write, without their line end: what ``commands.dispatch`` answers
    on a node that takes writes. Commands that read the store are not answered here: their reply is null."""
    own = arguments(wire, 4).withColumn("name", F.upper(F.col("args")[0].cast("string")))
    given, arg = F.col("argc") - 1, lambda i: F.col("args")[i]
    wrong = lambda name: F.lit(f"-ERR wrong number of arguments for '{name}' command")
    reply = (
        F.when(F.trim(F.col("wire")) == "+PING" + END, "+PONG")
        .when(F.coalesce(F.col("argc"), F.lit(0)) <= 0, "-ERR unknown command or invalid format")
        .when(F.col("name").isNull(), "-ERR invalid command format")
        .when(F.col("name") == "PING", "+PONG")
        .when(F.col("name").isin("HELLO", "CLIENT"), "+OK")
        .when(F.col("name") == "COMMAND", "*0")
        .when(F.col("name") == "SET", F.when(given != 2, wrong("set")).when(arg(1).isNull(), "-ERR invalid key").when(arg(2).isNull(), "-ERR invalid value").otherwise("+OK"))
        .when(F.col("name") == "DEL", F.when(given != 1, wrong("del")).when(arg(1).isNull(), "-ERR invalid key").otherwise(":1"))
        .when(F.col("name") == "GET", F.when(given != 1, wrong("get")).when(arg(1).isNull(), "-ERR invalid key"))
        .when(F.col("name") == "SCAN", F.when(given != 2, "-ERR usage: SCAN start_key end_key").when(arg(1).isNull(), "-ERR invalid start_key").when(arg(2).isNull(), "-ERR invalid end_key"))
        .otherwise(F.concat(F.lit("-ERR unknown command '"), "name", F.lit("'")))
    )
    return own.select("lsn", reply.alias("reply"))
