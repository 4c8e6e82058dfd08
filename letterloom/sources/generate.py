"""Made mailboxes for tests and measurements: threads, HTML, attachments, bulk mail, missing ids and lines like envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.sources.mbox import MONTHS

PEOPLE = ("Ada", "Ben", "Cleo", "Dov", "Eve", "Finn", "Gia", "Hugo", "Ines", "Jon", "Kai")
TOPICS = ("budget", "release", "garden party", "server move", "contract", "holiday rota", "audit", "logo")


def _pick(of: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(n, F.lit(len(of))) + 1).cast("int"))


def made_mail(spark: SparkSession, n: int, tasks: int | None = None) -> DataFrame:
    """id, kind (plain, html, mixed, spam) and value, the text of one message, of n messages. Message i answers message
    i - 7 of its thread unless i is below 7; every fifth has no id, every 17th a body line that begins like an envelope."""
    i = F.col("id")
    who, topic = _pick(PEOPLE, F.xxhash64("id")), _pick(TOPICS, F.pmod(i, F.lit(7)))
    kind = F.when(i % 11 == 10, "spam").when(i % 3 == 1, "html").when(i % 3 == 2, "mixed").otherwise("plain")
    day, month, year = (i % 28 + 1).cast("string"), _pick(MONTHS, F.floor(i / 28)), (F.lit(2015) + F.floor(i / 336) % 10).cast("string")
    head = F.concat_ws(
        "\n", F.concat(F.lit("From "), F.lower(who), F.lit("@made.example Mon "), month, F.lit(" "), F.lpad(day, 2, " "), F.lit(" 09:15:00 "), year),
        F.concat(F.lit("From: "), who, F.lit(" <"), F.lower(who), F.lit("@made.example>")), F.concat(F.lit("To: "), _pick(PEOPLE, F.xxhash64("id") + 1), F.lit(" <list@made.example>")),
        F.concat(F.lit("Date: "), day, F.lit(" "), month, F.lit(" "), year, F.lit(" 09:15:00 +0200")), F.concat(F.when(i >= 7, "Subject: Re: ").otherwise("Subject: "), topic),
        F.when(i % 5 != 0, F.concat(F.lit("Message-ID: <"), i.cast("string"), F.lit("@made.example>"))),
        F.when(i >= 7, F.concat(F.lit("References: <"), (i % 7).cast("string"), F.lit("@made.example> <"), (i - 7).cast("string"), F.lit("@made.example>"))),
        F.when(i % 11 == 10, "Precedence: bulk"), F.when(i % 4 == 0, "X-Gmail-Labels: Inbox,Work"),
    )
    said = F.concat(F.lit("About the "), topic, F.lit(": point "), i.cast("string"), F.lit(" is open."), F.when(i % 17 == 0, "\nFrom here on it is no envelope.").otherwise(""))
    page = F.concat(F.lit("<html><body><p>"), said, F.lit("</p><style>p{}</style></body></html>"))
    body = (
        F.when(i % 3 == 1, F.concat(F.lit("Content-Type: text/html; charset=utf-8\n\n"), page))
        .when(i % 3 == 2, F.concat(F.lit("Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\n"), said, F.lit("\n--b\nContent-Type: text/csv; name=t.csv\nContent-Disposition: attachment; filename=t.csv\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(i.cast("string"), "utf-8")), F.lit("\n--b--")))
        .otherwise(F.concat(F.lit("Content-Type: text/plain\n\n"), said, F.lit("\n-- \n"), who))
    )
    return spark.range(0, n, 1, tasks).select("id", kind.alias("kind"), F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("value"))


def write_mailboxes(mail: DataFrame, folder: str) -> str:
    """The messages as text files of a folder, one for each task; returns the pattern that read_mbox takes."""
    mail.select("value").write.mode("overwrite").text(folder)
    return f"{folder}/part-*"
