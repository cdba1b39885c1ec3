"""Tables as they are printed or sent: rows padded to their columns, widths, and what was sent last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a page without its margins, in millimetres, and the share of it that the first of several columns has.
WIDTH = 170.0
FIRST = 0.45


def padded(cells: Column | str, n: Column | int) -> Column:
    """Exactly ``n`` cells: surplus ones are cut off, missing ones empty."""
    cells, n = F.col(cells) if isinstance(cells, str) else cells, F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), n)), 1, n)


def widths(n: Column | str) -> Column:
    """The widths of ``n`` columns: the first is wider, the others are equal."""
    n = F.col(n) if isinstance(n, str) else n
    rest = F.lit(WIDTH * (1 - FIRST)) / (n - 1)
    return F.when(n <= 1, F.array(F.lit(WIDTH))).otherwise(F.concat(F.array(F.lit(WIDTH * FIRST)), F.array_repeat(rest, n.cast("int") - 1)))


def printed(sections: DataFrame) -> DataFrame:
    """Sections in lines: doc, section, nth (0 is the header, the last a sum if there is one), cells and widths.

    ``sections``: doc, section, title, columns (texts), rows (texts of texts) and total (texts, may be empty). Sections
    without columns are left out; titles are numbered by their place among all.
    """
    kept = sections.filter(F.size("columns") > 0)
    last = F.when(F.size(F.coalesce("total", F.array().cast("array<string>"))) > 0, F.array("total")).otherwise(F.array().cast("array<array<string>>"))
    lines = kept.select("doc", "section", F.when(F.col("title") != "", F.concat(F.col("section").cast("string"), F.lit(". "), "title")).otherwise("").alias("title"), "columns", F.posexplode(F.concat(F.array("columns"), "rows", last)).alias("nth", "line"))
    n = F.size("columns")
    return lines.select("doc", "section", "title", "nth", padded("line", n).alias("cells"), widths(n).alias("widths"))


def last_sent(sent: DataFrame, n: int, most: int = 20) -> DataFrame:
    """The last ``n`` messages of each chat that can be taken back: of those sent (chat, seq, message_id) only the last ``most`` are remembered."""
    nth = F.row_number().over(Window.partitionBy("chat").orderBy(F.col("seq").desc()))
    return sent.withColumn("nth", nth).filter(F.col("nth") <= min(n, most)).select("chat", "seq", "message_id")


def payment_requests(watches: DataFrame, contracts: DataFrame) -> DataFrame:
    """What is posted to the other program for each watch (id, client_id, amount, tx_date): the client's one contract with a remainder.

    contract_id, branch_id, amount in whole units (halves up) and paid_at; ``status`` says ready, none or several.
    """
    open_ = contracts.filter("remaining > 0").groupBy("client_id").agg(F.count("*").alias("n"), F.min("id").alias("contract_id"), F.min_by("branch_id", "id").alias("branch_id"))
    rows = watches.join(open_, "client_id", "left")
    one = F.col("n") == 1
    status = F.when(one, "ready").when(F.col("n").isNull(), "none").otherwise("several")
    amount = F.floor(F.col("amount").cast("decimal(20,4)") + 0.5).cast("long")
    return rows.select("id", status.alias("status"), F.when(one, F.col("contract_id")).alias("contract_id"), F.when(one, F.col("branch_id")).alias("branch_id"), amount.alias("amount"), F.col("tx_date").alias("paid_at"))
